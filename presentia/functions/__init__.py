"""Part of presentia."""

"""Which ordered sequence markers occur in which genomes, as Spark jobs."""

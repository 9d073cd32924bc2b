"""Where results go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def result_lines(bits: DataFrame) -> DataFrame:
    """(value): a line "name bits" for each genome."""
    return bits.select(F.concat_ws(" ", "name", "bits").alias("value"))


def write_result(bits: DataFrame, path: str, ordered: bool = False) -> None:
    """Result lines as text; ``ordered`` sorts them by genome_id over all part files."""
    rows = bits.orderBy("genome_id") if ordered else bits
    result_lines(rows).write.mode("overwrite").text(path)


def save_matrix(bits: DataFrame, path: str) -> None:
    """The matrix as Parquet, a row for each genome."""
    bits.write.mode("overwrite").parquet(path)


def load_matrix(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)

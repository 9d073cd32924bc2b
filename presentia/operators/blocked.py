"""The presence matrix in packed blocks, for widths at which a row of text bits is too long.

A row has one genome's bits of one block of ``BLOCK`` ordinals as 64-bit words; blocks
without a 1 have no row. Stored as Parquet partitioned by block, a cell or a column
reads one block; two matrices are combined word by word, and ones are counted by
bit_count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = 64
BLOCK = 1 << 16


def pack(hits: DataFrame, block: int = BLOCK) -> DataFrame:
    """(genome_id, block, words) from (genome_id, ordinal) of the 1s, repeated or not; ``block`` is a multiple of 64."""
    bit = F.expr(f"shiftleft(1L, cast(ordinal % {WORD} AS INT))")
    words = hits.groupBy("genome_id", F.expr(f"ordinal div {block}").cast("int").alias("block"), F.expr(f"(ordinal % {block}) div {WORD}").cast("int").alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    held = F.map_from_entries(F.collect_list(F.struct("_word", "_bits")))  # block / 64 at most
    dense = F.transform(F.sequence(F.lit(0), F.lit(block // WORD - 1)), lambda i: F.coalesce(F.try_element_at("_held", i), F.lit(0).cast("long")))
    return words.groupBy("genome_id", "block").agg(held.alias("_held")).select("genome_id", "block", dense.alias("words"))


def save(packed: DataFrame, path: str) -> None:
    """As Parquet, a folder for each block; a block's rows aren't in more files than tasks that have some."""
    packed.repartition("block", F.pmod(F.hash("genome_id"), F.lit(8))).write.mode("overwrite").partitionBy("block").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("genome_id long, words array<long>, block int").parquet(path).select("genome_id", "block", "words")


def bit(ordinal: int, block: int = BLOCK):
    """Column: the bit of an ordinal in its block's words."""
    at = ordinal % block
    return F.shiftrightunsigned(F.get("words", F.lit(at // WORD)), at % WORD).bitwiseAND(F.lit(1)).cast("tinyint")


def column(packed: DataFrame, genomes: DataFrame, ordinal: int, block: int = BLOCK) -> DataFrame:
    """(genome_id, present) of one marker for all ``genomes`` (genome_id); one block is read."""
    held = packed.where(F.col("block") == ordinal // block).select("genome_id", bit(ordinal, block).alias("present"))
    return genomes.select("genome_id").join(held, "genome_id", "left").select("genome_id", F.coalesce("present", F.lit(0).cast("tinyint")).alias("present"))


def cell(packed: DataFrame, genomes: DataFrame, genome_id: int, ordinal: int, block: int = BLOCK) -> DataFrame:
    """(genome_id, ordinal, present) of one cell; no row for an unknown genome."""
    one = F.col("genome_id") == genome_id
    return column(packed.where(one), genomes.where(one), ordinal, block).select("genome_id", F.lit(ordinal).alias("ordinal"), "present")


def combine(a: DataFrame, b: DataFrame, how: str = "or") -> DataFrame:
    """Two packed matrices word by word: "or", "and" or "xor"; what one lacks is 0."""
    how = {"or": "bitwiseOR", "and": "bitwiseAND", "xor": "bitwiseXOR"}[how]
    both = a.select("genome_id", "block", F.col("words").alias("_a")).join(b.select("genome_id", "block", F.col("words").alias("_b")), ["genome_id", "block"], "full_outer")
    zeros = F.transform(F.coalesce("_a", "_b"), lambda _: F.lit(0).cast("long"))
    return both.select("genome_id", "block", F.zip_with(F.coalesce("_a", zeros), F.coalesce("_b", zeros), lambda x, y: getattr(x, how)(y)).alias("words"))


def ones(packed: DataFrame) -> DataFrame:
    """(genome_id, ones): how many 1s each genome has; genomes without any have no row."""
    n = F.aggregate("words", F.lit(0).cast("long"), lambda s, x: s + F.bit_count(x))
    return packed.groupBy("genome_id").agg(F.sum(n).alias("ones")).where("ones > 0")


def unpack(packed: DataFrame, block: int = BLOCK) -> DataFrame:
    """(genome_id, ordinal) of the 1s."""
    words = packed.select("genome_id", "block", F.posexplode("words").alias("_at", "_word")).where("_word != 0")
    set_bits = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.bit_get("_word", i) == 1)
    each = words.select("genome_id", "block", "_at", F.explode(set_bits).alias("_bit"))
    return each.select("genome_id", (F.col("block").cast("long") * block + F.col("_at") * WORD + F.col("_bit")).alias("ordinal"))

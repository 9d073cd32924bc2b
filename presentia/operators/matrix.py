"""The presence matrix: dense bits for each genome, its long form, and operations on both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presentia.functions import dna
from presentia.operators import matching, scanning
from presentia.operators.matching import STRIDE, match


def dedupe_markers(markers: DataFrame) -> DataFrame:
    """(seq, first_ordinal, ordinals): each sequence once, with all its columns."""
    return markers.groupBy("seq").agg(F.min("ordinal").alias("first_ordinal"), F.array_sort(F.collect_list("ordinal")).alias("ordinals"))


def fan_out(hits: DataFrame, markers: DataFrame) -> DataFrame:
    """(genome_id, ordinal): hits of a sequence for every marker that has it."""
    return hits.join(markers.select("ordinal", "seq"), "seq").select("genome_id", "ordinal")


def members(markers: DataFrame, found: DataFrame) -> DataFrame:
    """The markers whose sequence was found."""
    return markers.join(found.select("seq"), "seq", "left_semi")


def to_bits(genomes: DataFrame, hits: DataFrame, width: int) -> DataFrame:
    """``genomes`` (without seq) with bits: a dense row for each genome, also where nothing was found."""
    ones = hits.groupBy("genome_id").agg(F.collect_set("ordinal").alias("ones"))
    out = genomes.drop("seq").join(ones, "genome_id", "left")
    return out.withColumn("bits", dna.bits_of(F.coalesce("ones", F.array().cast("array<int>")), F.lit(width))).drop("ones")


def presence_bits(genomes: DataFrame, markers: DataFrame, strategy: str = "auto", stride: int = STRIDE) -> DataFrame:
    """Each genome with a string of one bit for each marker, in order of ordinals from 0."""
    facts = [F.coalesce(F.max("ordinal") + 1, F.lit(0)), F.min("ordinal"), F.count("*"), F.count_distinct("ordinal"), F.sum(F.length("seq"))]
    width, least, n, distinct, bases = markers.agg(*facts).first()
    if strategy == "auto" and 0 < width <= matching.BROADCAST_MARKERS and least >= 0 and n == distinct and (bases or 0) <= matching.BROADCAST_BASES:
        return _few_bits(genomes, markers, width, stride)
    hits = fan_out(match(genomes, markers, strategy, stride), markers)
    return to_bits(genomes, hits.withColumn("ordinal", F.col("ordinal").cast("int")), width)


def _few_bits(genomes: DataFrame, markers: DataFrame, width: int, stride: int) -> DataFrame:
    """presence_bits() of few markers: bits are set where a chunk is scanned, and no row is made for a hit."""
    columns: list[str | None] = [None] * width
    for r in markers.where(dna.is_valid_marker(F.col("seq"))).select("ordinal", "seq").toLocalIterator():  # `width` at most
        columns[r.ordinal] = r.seq
    longest = max((len(m) for m in columns if m), default=1)
    words = scanning.found(matching.chunks(genomes.select("genome_id", "seq"), longest, stride if stride != STRIDE else max(stride, longest)), columns)
    out = genomes.drop("seq").join(words, "genome_id", "left")
    return out.withColumn("bits", F.coalesce(scanning.as_bits(F.col("words"), width), F.lit("0" * width))).drop("words")


def to_long(bits: DataFrame) -> DataFrame:
    """(genome_id, ordinal, present): a row for each bit."""
    each = F.filter(F.split("bits", ""), lambda x: x != "")
    return bits.select("genome_id", F.posexplode(each).alias("ordinal", "bit")).select("genome_id", "ordinal", F.col("bit").cast("tinyint").alias("present"))


def from_long(rows: DataFrame, width: int) -> DataFrame:
    """(genome_id, bits) from (genome_id, ordinal, present)."""
    ones = rows.groupBy("genome_id").agg(F.collect_set(F.when(F.col("present") == 1, F.col("ordinal"))).alias("ones"))
    return ones.select("genome_id", dna.bits_of(F.col("ones"), F.lit(width)).alias("bits"))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """(genome_id, ordinal, present) of either, 1 where either has 1."""
    return a.unionByName(b).groupBy("genome_id", "ordinal").agg(F.max("present").alias("present"))


def reconcile(a: DataFrame, b: DataFrame) -> DataFrame:
    """(name, a_bits, b_bits) where two results differ, also where one lacks a genome."""
    left, right = a.select("name", F.col("bits").alias("a_bits")), b.select("name", F.col("bits").alias("b_bits"))
    return left.join(right, "name", "full_outer").where(~F.col("a_bits").eqNullSafe(F.col("b_bits")))


def repeated_genomes(genomes: DataFrame) -> DataFrame:
    """(name, n) of names that occur more than once; a matrix needs none."""
    return genomes.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")


def cell(bits: DataFrame, genome_id: int, ordinal: int) -> DataFrame:
    """(genome_id, ordinal, present) of one cell; no row for an unknown genome."""
    one = F.substring(F.col("bits"), ordinal + 1, 1)
    return bits.where(F.col("genome_id") == genome_id).select("genome_id", F.lit(ordinal).alias("ordinal"), one.cast("tinyint").alias("present"))


def marker_column(bits: DataFrame, ordinal: int) -> DataFrame:
    """(genome_id, present) of one marker."""
    return bits.select("genome_id", F.substring(F.col("bits"), ordinal + 1, 1).cast("tinyint").alias("present"))

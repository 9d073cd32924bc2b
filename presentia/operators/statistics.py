"""Counts and sizes of marker and genome tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def marker_statistics(markers: DataFrame) -> DataFrame:
    """One row: n_markers, n_bases, and estimates of an index's size in vertices, as a sum and with shared prefixes."""
    n, bases = F.count("*"), F.coalesce(F.sum(F.length("seq")), F.lit(0))
    shared = F.when(n > 1, F.ceil(bases - n * F.log(4.0, n / 2) + 4)).otherwise(bases + 24)
    return markers.agg(n.alias("n_markers"), bases.cast("long").alias("n_bases"), (bases + 24).cast("long").alias("size_sum"), shared.cast("long").alias("size_shared"))


def genome_statistics(genomes: DataFrame) -> DataFrame:
    """One row: n_genomes, longest, shortest and mean length."""
    length = F.length("seq")
    return genomes.agg(F.count("*").alias("n_genomes"), F.max(length).cast("long").alias("longest"), F.min(length).cast("long").alias("shortest"), F.avg(length).alias("mean_length"))


def common_prefix(a: Column, b: Column) -> Column:
    """The length of the common prefix of two texts, by halving: as many comparisons as its length has binary digits."""
    start = F.struct(F.lit(0).alias("low"), F.least(F.length(a), F.length(b)).alias("high"))
    middle = lambda s: F.ceil((s["low"] + s["high"]) / 2).cast("int")
    equal = lambda s: F.left(a, middle(s)) == F.left(b, middle(s))
    step = lambda s, _: F.struct(F.when(equal(s), middle(s)).otherwise(s["low"]).alias("low"), F.when(equal(s), s["high"]).otherwise(middle(s) - 1).alias("high"))
    rounds = F.sequence(F.lit(1), F.ceil(F.log2(F.least(F.length(a), F.length(b)) + F.lit(2.0))).cast("int") + 1)
    return F.aggregate(rounds, start, step, lambda s: s["low"])


def distinct_prefixes(markers: DataFrame) -> DataFrame:
    """One row: n_prefixes, the vertices of a tree of all markers without its root.

    Of sorted markers each adds its length less what it has in common with the one
    before. Ranges are sorted apart; what meets in one task is a row for each range.
    """
    n = int(markers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_apart = markers.where("seq != ''").select("seq").distinct().repartitionByRange(n, "seq").withColumn("_part", F.spark_partition_id())
    before = F.lag("seq").over(Window.partitionBy("_part").orderBy("seq"))
    each = sorted_apart.withColumn("_before", before)
    new = F.length("seq").cast("long") - F.coalesce(common_prefix(F.col("seq"), F.col("_before")), F.lit(0))
    parts = each.groupBy("_part").agg(F.sum(new).alias("_new"), F.min("seq").alias("_first"), F.max("seq").alias("_last"))
    parts = parts.withColumn("_before", F.lag("_last").over(Window.orderBy("_part")))
    shared = F.coalesce(common_prefix(F.col("_first"), F.col("_before")), F.lit(0))
    return parts.agg(F.coalesce(F.sum(F.col("_new") - shared), F.lit(0)).cast("long").alias("n_prefixes"))

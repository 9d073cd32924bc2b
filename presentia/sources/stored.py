"""Results that are kept by genome: a rerun matches only genomes that are new or have changed."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presentia.operators import matrix


def workspace(spark: SparkSession, what: str) -> str:
    """A new folder in the one that driver and executors share, spark.checkpoint.dir; a temporary one only where that is unset in local mode."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir isn't set; on a cluster it names a folder that driver and executors share")
    return f"{base or tempfile.mkdtemp(prefix='presentia-')}/{what}-{uuid.uuid4().hex}"


def marker_set(markers: DataFrame) -> str:
    """A name for a marker table's content, whatever the order of its rows."""
    row = markers.select(*[F.xxhash64(F.lit(k), "ordinal", "seq").alias(f"h{k}") for k in (1, 2)])
    r = row.agg(F.count("*").alias("n"), F.bit_xor("h1").alias("x"), F.bit_xor("h2").alias("y")).first()
    return f"{r.n}:{r.x or 0:x}:{r.y or 0:x}"


def stored(spark: SparkSession, store: str) -> DataFrame | None:
    """(name, content, marker_set, bits) of a store; None if there is none yet."""
    try:
        return spark.read.schema("content string, marker_set string, bits string, name string").parquet(store)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def stale(genomes: DataFrame, marker_name: str, known: DataFrame | None) -> DataFrame:
    """``genomes`` (genome_id, name, seq) with content, a hash of seq; only those that ``known`` lacks with this content and these markers."""
    each = genomes.withColumn("content", F.sha2("seq", 256))
    if known is None:
        return each
    return each.join(known.where(F.col("marker_set") == marker_name).select("name", "content"), ["name", "content"], "left_anti")


def update(genomes: DataFrame, markers: DataFrame, store: str, strategy: str = "auto") -> DataFrame:
    """(genome_id, name, bits) of ``genomes`` (genome_id, name, seq, names once), of which only stale ones are matched.

    ``store`` is Parquet with a folder for each genome. What is matched replaces its genome's folder,
    all others stay as they are; those of genomes that aren't asked for stay, too.
    """
    spark, name = genomes.sparkSession, marker_set(markers)
    if again := matrix.repeated_genomes(genomes).head(1):
        raise ValueError(f"genome {again[0].name} occurs {again[0].n} times")
    todo = stale(genomes, name, stored(spark, store))
    bits = matrix.presence_bits(todo, markers, strategy).select("content", F.lit(name).alias("marker_set"), "bits", "name")
    bits.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("name").parquet(store)
    found = stored(spark, store)
    if found is None:  # no genomes, no folder
        return genomes.select("genome_id", "name", F.lit("").alias("bits")).where("false")
    return genomes.select("genome_id", "name").join(found.where(F.col("marker_set") == name).select("name", "bits"), "name").select("genome_id", "name", "bits")

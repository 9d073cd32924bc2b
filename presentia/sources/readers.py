"""Genomes, markers, manifests and results as DataFrames; paths may be in any store that Spark reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presentia.functions import dna


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, line) of one text file in its own order; a last line break adds no line."""
    whole = spark.read.text(path, wholetext=True)
    lines = F.split(F.regexp_replace("value", "\r?\n\\z", ""), "\r?\n")
    return whole.where("value != ''").select(F.posexplode(lines).alias("ordinal", "line"))


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, line) of one text file of any size, read in splits.

    Lines are numbered within their split, after as many as the splits before have;
    the only table in one task has a row for each split.
    """
    rows = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_at"))
    sizes = rows.groupBy("_split").count()
    before = sizes.select("_split", (F.sum("count").over(Window.orderBy("_split")) - F.col("count")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_split").orderBy("_at")) - 1
    numbered = rows.withColumn("_within", within).join(F.broadcast(before), "_split")  # a row for each split
    return numbered.select((F.col("_before") + F.col("_within")).cast("int").alias("ordinal"), "line")


def spread_rows(table: DataFrame) -> DataFrame:
    """A table as it is read, dealt out by rows if it has fewer splits than the cluster has cores."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def read_manifest(spark: SparkSession, path: str, base_dir: str | None = None) -> DataFrame:
    """(ordinal, path, name): the genome files that a manifest lists, relative to its folder or to ``base_dir``."""
    base = base_dir if base_dir is not None else path.rpartition("/")[0] or "."
    listed = _lines(spark, path).where("line != ''")
    full = F.when(F.col("line").rlike("^([a-z]+:)?/"), F.col("line")).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), "line"))
    return listed.select("ordinal", full.alias("path"), dna.basename(F.col("line")).alias("name"))


def write_manifest(names: DataFrame, path: str, column: str = "name") -> None:
    """One name a line."""
    names.select(F.col(column).cast("string")).write.mode("overwrite").text(path)


def read_genome_files(spark: SparkSession, paths: Sequence[str] | str, first_line_only: bool = False, upper: bool = True) -> DataFrame:
    """(path, name, seq) of whole files, plain or FASTA, also .gz, normalised."""
    text = F.split("value", "\r?\n")[0] if first_line_only else F.col("value")
    files = spark.read.text(paths if isinstance(paths, str) else list(paths), wholetext=True).withColumn("path", F.input_file_name())
    joined = F.array_join(F.filter(F.split(text, "\r?\n"), lambda x: ~F.startswith(x, F.lit(">"))), "")
    return files.select("path", dna.basename(F.col("path")).alias("name"), dna.normalise(joined, upper).alias("seq"))


def read_genomes(spark: SparkSession, manifest: str, base_dir: str | None = None, first: int | None = None, first_line_only: bool = False) -> DataFrame:
    """(genome_id, name, seq) of the genomes of a manifest; genome_id is the place in it. An empty manifest is an error."""
    listed = read_manifest(spark, manifest, base_dir)
    if first is not None:
        listed = listed.where(F.col("ordinal") < first)
    paths = [r.path for r in listed.select("path").distinct().toLocalIterator()]  # file names, as a file listing has
    if not paths:
        raise ValueError(f"no genomes in {manifest}")
    key = lambda c: F.regexp_replace(F.url_decode(F.regexp_replace(c, r"\+", "%2B")), "^[a-z]+:/*", "/")
    found = read_genome_files(spark, paths, first_line_only).select(key(F.col("path")).alias("_key"), "seq")
    wanted = listed.withColumn("_key", F.regexp_replace("path", "^[a-z]+:/*", "/"))
    wanted = wanted.withColumn("_key", F.regexp_replace("_key", "/\\./", "/"))
    if stray := found.select("_key").join(wanted.select("_key"), "_key", "left_anti").head(1):
        raise ValueError(f"{stray[0]._key} isn't a path of the manifest")
    # Spark's reader gives no row for an empty file, which is an empty genome
    return wanted.join(found, "_key", "left").select(F.col("ordinal").cast("long").alias("genome_id"), "name", F.coalesce("seq", F.lit("")).alias("seq"))


def read_markers(spark: SparkSession, path: str, first: int | None = None, strict: bool = False) -> DataFrame:
    """(ordinal, marker_id, seq) of a CSV of id and sequence without a header; the ordinal is the line's number.

    An id that is no whole number is null, or an error that names its line if ``strict``;
    bad_markers() has such lines as a table.
    """
    rows = _marker_rows(spark, path)
    if strict:
        wrong = F.raise_error(F.concat(F.lit(f"{path}, line "), (F.col("ordinal") + 1).cast("string"), F.lit(": "), F.col("reason")))
        rows = rows.withColumn("ordinal", F.when(F.col("reason").isNull(), F.col("ordinal")).otherwise(wrong.cast("int")))
    out = rows.select("ordinal", "marker_id", "seq")
    return out if first is None else out.where(F.col("ordinal") < first)


def _marker_rows(spark: SparkSession, path: str) -> DataFrame:
    row = F.from_csv("line", "id STRING, seq STRING, more STRING")
    rows = _numbered_lines(spark, path).select("ordinal", "line", row.alias("r"))
    number = F.trim("r.id").try_cast("int")
    reason = F.when(F.col("r.id").isNotNull() & number.isNull(), "the id isn't a whole number").when(F.col("r.more").isNotNull(), "more than two fields").when((F.trim("line") != "") & F.col("r.id").isNull(), "no id")
    return rows.select("ordinal", "line", number.alias("marker_id"), F.coalesce("r.seq", F.lit("")).alias("seq"), reason.alias("reason"))


def bad_markers(spark: SparkSession, path: str) -> DataFrame:
    """(line_number, line, reason): the lines of a marker CSV that aren't an id and a sequence, for a quarantine table; numbers from 1."""
    return _marker_rows(spark, path).where("reason IS NOT NULL").select((F.col("ordinal") + 1).alias("line_number"), "line", "reason")


def genomes_from(spark: SparkSession, sequences: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
    """(genome_id, name, seq) from a list in memory."""
    names = names or [f"genome{i}" for i in range(len(sequences))]
    rows = spark.createDataFrame(list(zip(range(len(sequences)), names, sequences, strict=True)), "genome_id LONG, name STRING, seq STRING")
    return rows.withColumn("seq", dna.normalise(F.col("seq"), upper=False))


def markers_from(spark: SparkSession, sequences: Sequence[str], ids: Sequence[int] | None = None) -> DataFrame:
    """(ordinal, marker_id, seq) from a list in memory; ids must be whole numbers."""
    ids = list(ids) if ids is not None else list(range(1, len(sequences) + 1))
    if any(not isinstance(i, int) or isinstance(i, bool) for i in ids):
        raise TypeError("a marker's id is an int")
    return spark.createDataFrame(list(zip(range(len(sequences)), ids, sequences, strict=True)), "ordinal INT, marker_id INT, seq STRING")


def genomes_from_one_hot(rows: DataFrame) -> DataFrame:
    """``rows`` with seq decoded from arrays a, c, g, t."""
    return rows.withColumn("seq", dna.normalise(dna.from_one_hot(F.struct("a", "c", "g", "t")), upper=False)).drop("a", "c", "g", "t")


def read_result(spark: SparkSession, path: str) -> DataFrame:
    """(name, bits) of result lines."""
    parts = F.split("value", " ")
    return spark.read.text(path).where("value != ''").select(parts[0].alias("name"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("bits"))


def to_download(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """The manifest entries whose files aren't there yet."""
    return wanted.join(present.select("name").distinct(), "name", "left_anti")

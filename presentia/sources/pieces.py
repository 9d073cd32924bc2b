"""Genome files of any size, read in splits: one file is many tasks.

Spark's text reader gives the lines of every split of a file in order. A split's lines
are joined to chunks of ``stride`` bases, each with the bases that follow it in its
split. What crosses the end of a split is in a seam: the last bases of the split with
the first ones of those after it, however short these are. So every stretch of up to
``longest`` bases lies whole in a chunk or a seam, no base of a file passes through one
task with the rest of it, and only seams, two short texts a split, are shuffled.

A genome that is one line isn't split by lines. ``separator``, some bases in a row, is
then what parts records, and is put back before each but a file's first. Spark has no
record after a separator that ends a file; where a file has more bytes than its records,
its last seam has that separator. Such files are ASCII.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presentia.functions import dna
from presentia.operators.matching import STRIDE


def records(spark: SparkSession, paths: Sequence[str] | str, separator: str | None = None) -> DataFrame:
    """(path, block, size, line): the lines of plain or FASTA files without headers, in the order of each split; ``block`` is the byte where the split begins, ``size`` the file's."""
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    rows = reader.text(paths if isinstance(paths, str) else list(paths))
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("line"))
    return rows if separator else rows.where(~F.startswith("line", F.lit(">")))


def _joined(batches: Iterator[pd.DataFrame], separator: str | None, least: int) -> Iterator[tuple[str, int, str]]:
    """(path, block, text) of a split's records in turn, joined to ``least`` bases or more, but for a split's last."""
    here, parts, size, fresh = None, [], 0, True
    for batch in batches:
        for path, block, line in zip(batch["path"], batch["block"], batch["line"], strict=True):
            if here != (path, block):
                if parts:
                    yield *here, "".join(parts)
                here, parts, size, fresh = (path, block), [], 0, True
            first = block == 0 and not parts and fresh
            parts.append(line.rstrip("\r") if separator is None else ("" if first else separator) + line)
            fresh = False
            size += len(parts[-1])
            if size >= least:
                yield *here, "".join(parts)
                parts, size = [], 0
    if parts:
        yield *here, "".join(parts)


def read_pieces(spark: SparkSession, paths: Sequence[str] | str, longest: int, stride: int = STRIDE, separator: str | None = None) -> DataFrame:
    """(path, chunk_no, chunk), normalised: all stretches of up to ``longest`` bases of each file lie in one of its chunks."""
    reach, lines = max(0, longest - 1), records(spark, paths, separator)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, nth, left = None, 0, ""
        for path, block, text in _joined(batches, separator, stride):
            if here != (path, block):
                if left:
                    yield pd.DataFrame([(*here, nth, left)], columns=["path", "block", "nth", "chunk"])
                here, nth, left = (path, block), 0, ""
            left += text
            at = 0
            while len(left) - at >= stride + reach:
                yield pd.DataFrame([(path, block, nth, left[at : at + stride + reach])], columns=["path", "block", "nth", "chunk"])
                at, nth = at + stride, nth + 1
            left = left[at:]
        if left:
            yield pd.DataFrame([(*here, nth, left)], columns=["path", "block", "nth", "chunk"])

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, head, tail, n = None, "", "", 0
        for path, block, text in _joined(batches, separator, stride):
            if here != (path, block):
                if here:
                    yield pd.DataFrame([(*here, head, tail, n)], columns=["path", "block", "head", "tail", "n"])
                here, head, tail, n = (path, block), "", "", 0
            n += len(text)
            head = (head + text[: reach - len(head)]) if len(head) < reach else head
            tail = (tail + text)[-reach:] if reach else ""
        if here:
            yield pd.DataFrame([(*here, head, tail, n)], columns=["path", "block", "head", "tail", "n"])

    chunks = lines.mapInPandas(cut, "path string, block long, nth long, chunk string")
    chunks = chunks.select("path", F.concat_ws(":", "block", "nth").alias("chunk_no"), dna.normalise(F.col("chunk")).alias("chunk"))
    splits = lines.mapInPandas(ends, "path string, block long, head string, tail string, n long")
    own = Window.partitionBy("path")  # the splits of one file
    after = own.orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    rest = F.lit("")
    if separator:
        sizes = lines.groupBy("path").agg(F.max("size").alias("size"))
        splits = splits.join(sizes, "path").withColumn("_all", F.sum("n").over(own))
        rest = F.when(F.col("_all") + len(separator) <= F.col("size"), F.lit(separator)).otherwise(rest)
    seams = splits.withColumn("next", F.left(F.concat(F.array_join(F.collect_list("head").over(after), ""), rest), F.lit(max(reach, len(separator or ""))))).where("next != ''")
    seams = seams.select("path", F.concat(F.col("block").cast("string"), F.lit(":seam")).alias("chunk_no"), dna.normalise(F.concat("tail", "next")).alias("chunk"))
    return chunks.union(seams) if reach or separator else chunks

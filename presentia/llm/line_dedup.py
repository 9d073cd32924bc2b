"""Operator 6: line dedup by pairwise alignment.

Lines that aren't blank are compared by 128 bits of hash after trimming. Anchors are
the shortest runs of lines of ``min_words`` words or more, one that begins and one that
ends at each line: any common block of so many words is covered by the anchors
in it. Every anchor, however frequent, pairs its document with the first (smallest
id) that holds it, and with no other, so rows grow with the lines, never with the
square of a group, and no document's lines are sent along with a pair. The anchors of
a pair are aligned by patience diff: those that are once on both sides, their longest
increasing run, extended over the others that fit between. Aligned blocks are deleted
from the later document. Then, unless ``moved`` is off, what is left is aligned again
until nothing is, for the blocks that moved: in the end the lines in a run of
``min_words`` or more that an earlier document has are gone.

Defined results: null texts and null ids are left as they are; blank lines are
deleted where the lines before and after them are; rows that share an id and have
different texts are different documents, in the order of a hash of the text, and those
with equal texts are one; exact copies but the first have no words left, and
``drop_emptied`` drops these; an empty table gives an empty result. Columns named as the
result's (n_lines, removed_lines, n_removed) are replaced.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presentia.llm.common import cut, let, read_table, row_hashes

SPACE = " \t\x0b\x0c\r"
POSITIONS = T.ArrayType(T.IntegerType())
ANCHORS = T.ArrayType(T.StructType([T.StructField("hash", T.BinaryType()), *(T.StructField(c, T.IntegerType()) for c in ("place", "upto", "first", "last"))]))


def longest_rising(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence, by patience piles."""
    tops, at, back = [], [], []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        back.append(at[k - 1] if k else -1)
        if k == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[k], at[k] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def aligned(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the matches (position in the later, in the earlier document) patience diff aligns."""
    pairs, which = np.unique(np.stack([i, -j], axis=1), axis=0, return_inverse=True)  # of one place the latest first, so that a rising run has it once
    i, j = pairs[:, 0].tolist(), (-pairs[:, 1]).tolist()
    in_a, in_b = Counter(i), Counter(j)
    once = [k for k in range(len(i)) if in_a[i[k]] == in_b[j[k]] == 1] or list(range(len(i)))
    spine = [once[k] for k in longest_rising([j[k] for k in once])]
    fits, last_i, last_j, at = np.zeros(len(i), bool), -1, -1, 0
    for k in range(len(i)):
        if at < len(spine) and k == spine[at]:
            at += 1
        elif not (i[k] > last_i and j[k] > last_j and (at == len(spine) or i[k] < i[spine[at]] and j[k] < j[spine[at]])):
            continue
        fits[k], last_i, last_j = True, i[k], j[k]
    return fits[which.reshape(-1)]


def blocks(i: np.ndarray, j: np.ndarray, moved: bool) -> np.ndarray:
    """Which matches go: those aligned, and if ``moved`` those aligned among what is left, until nothing is."""
    gone = np.zeros(len(i), bool)
    while len(left := np.flatnonzero(~gone)):
        fits = aligned(i[left], j[left])
        gone[left[fits]] = True
        if not moved or not fits.any():
            break
    return gone


def anchors(one: np.ndarray, two: np.ndarray, words: np.ndarray, at: np.ndarray, min_words: int) -> list[tuple[bytes, int, int, int, int]]:
    """(hash, first and last place among lines that aren't blank, first and last line) of the runs of ``min_words`` or more, one from each line and one to each."""
    if not len(one):
        return []
    total, both = np.cumsum(words), np.stack([one, two], axis=1)
    ends = np.searchsorted(total, total - words + min_words)  # last line of the run from each
    starts = np.searchsorted(total - words, total - min_words, "right") - 1  # first line of the run to each
    n = len(one)
    runs = sorted({(a, b) for a, b in zip(range(n), ends.tolist(), strict=True) if b < n} | {(a, b) for a, b in zip(starts.tolist(), range(n), strict=True) if a >= 0})
    return [(xxhash.xxh3_128_digest(both[a : b + 1].tobytes()), a, b, int(at[a]), int(at[b])) for a, b in runs]


def covered(place: np.ndarray, upto: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The lines of runs, and the blank ones between a run and one that follows it."""
    if not len(place):
        return np.zeros(0, np.int64)
    order = np.argsort(place, kind="stable")
    reach = np.maximum.accumulate(upto[order])
    begins = np.append(True, place[order][1:] > reach[:-1] + 1)
    at = np.flatnonzero(begins)
    return np.concatenate([np.arange(a, b + 1) for a, b in zip(first[order][at], np.maximum.reduceat(last[order], at), strict=True)])


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 8, drop_emptied: bool = False, moved: bool = True) -> DataFrame:
    """``docs`` with repeated blocks deleted from ``text``, and n_lines, removed_lines (positions from 0) and n_removed."""
    docs = docs.drop("n_lines", "removed_lines", "n_removed")
    own = F.struct(F.col(doc_id).alias("id"), *[h.alias(f"t{i}") for i, h in enumerate(row_hashes(text))])
    split = F.split(F.col(text), "\n")
    trimmed = F.transform(split, lambda x: F.trim(x, F.lit(SPACE)))
    count = lambda x: F.when(x == "", 0).otherwise(F.size(F.split(x, r"[\x20\x09-\x0D]+")))
    lines = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(own.alias("id"), trimmed.alias("lines"))
    hashes = [F.transform("lines", lambda x: F.xxhash64(x)).alias("one"), F.transform("lines", lambda x: F.xxhash64(F.lit(1), x)).alias("two")]
    lines = lines.select("id", F.struct(*hashes, F.transform("lines", count).alias("words")).alias("l"))
    lines = lines.groupBy("id").agg(F.first("l").alias("l"))  # equal texts

    @F.pandas_udf(ANCHORS)
    def anchors_of(lines: pd.DataFrame) -> pd.Series:
        rows = []
        for one, two, words in zip(*(lines[c].map(np.asarray) for c in ("one", "two", "words")), strict=True):
            at = np.flatnonzero(words)
            rows.append(anchors(one[at], two[at], words[at], at, min_words))
        return pd.Series(rows, dtype=object)

    each = cut(lines.select("id", F.explode(anchors_of("l")).alias("a")).select("id", "a.*"))
    shared = each.groupBy("hash").agg(F.min(F.struct("id", "place")).alias("first"), F.max("id").alias("last")).where("first.id < last")
    shared = shared.select("hash", F.col("first.id").alias("owner"), F.col("first.place").alias("there"))
    met = each.join(shared, "hash").where("id > owner").select("id", "owner", "place", "upto", "there", "first", "last")

    @F.pandas_udf(POSITIONS)
    def repeated(matches: pd.Series) -> pd.Series:
        out = []
        for rows in matches:
            i, j, *runs = (np.array([x[c] for x in rows]) for c in ("place", "there", "upto", "first", "last"))
            keep = blocks(i, j, moved)
            out.append(covered(i[keep], *(x[keep] for x in runs)))
        return pd.Series(out, dtype=object)

    pair = met.groupBy("id", "owner").agg(F.collect_list(F.struct("place", "upto", "there", "first", "last")).alias("matches"))  # two at most for each line of one document
    removed = pair.select("id", F.explode(repeated("matches")).alias("at"))
    removed = removed.groupBy("id").agg(F.sort_array(F.collect_set("at")).alias("removed_lines"))  # positions of one document
    removed = removed.withColumnRenamed("id", "_of")
    out = docs.withColumn("_own", own)
    out = out.join(removed, out["_own"] == removed["_of"], "left").drop("_own", "_of")
    out = out.withColumns({"removed_lines": F.coalesce("removed_lines", F.array().cast(POSITIONS)), "n_lines": F.coalesce(F.size(split), F.lit(0)).cast("long")})
    out = out.withColumn("n_removed", F.size("removed_lines").cast("long"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("removed_lines"))
    rebuilt = let(split, lambda ls: F.array_join(F.transform(kept, lambda i: F.get(ls, i)), "\n"))
    if drop_emptied:
        # nothing is left of a document if all its lines but blank ones are gone
        out = out.where((F.col("n_removed") == 0) | rebuilt.rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn(text, F.when(F.col("n_removed") > 0, rebuilt).otherwise(F.col(text)))


def query(spark, sf_dir: str) -> DataFrame:
    """op6: every document's lines that repeat an earlier document's, and its text without them."""
    return line_dedup(read_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "removed_lines", "text")

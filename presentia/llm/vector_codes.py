"""Operator 11: vector code compression, codebook entries found by VA-file filtering.

Components become integers, floor(``scale`` x), and a vector is cut into ``parts``
consecutive parts, each with a codebook of ``entries``. Rounds assign every part to its
nearest entry and move entries to the mean; partial sums go by (part, entry), so that
only codebooks, whose size is fixed, meet at the driver.

The nearest entry is found as in a VA-file: each coordinate of the entries is
quantised to 2 ** ``bits`` cells between quantiles of that coordinate. For a part to be
coded, a table gives for each coordinate and cell the least and the largest squared
distance to anything in the cell; sums over an entry's cells bound its distance. Only
entries whose lower bound isn't above the least upper bound are refined by integer
distances; ties go to the lower index. Bounds are integers, so nothing is lost.

Defined results: rows whose vector is null, empty, of a length that ``parts`` doesn't
divide or that isn't the length of the smallest id's vector, or that has a null or
non-finite component, are dropped; components beyond 2 ** 40 are taken as that,
and sums of errors end at 2 ** 63 - 1; null ids are coded and come last in the first
codebooks; equal ids are ordered by their vectors; with fewer than ``entries`` vectors
codebooks are as small; null labels are one label; an empty table gives an empty
result; other columns stay as they are (those of the result are replaced).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presentia.llm.common import cut, read_table

#: Largest component; and the largest one whose squared distances are computed in 64 bits.
MOST, SAFE = 1 << 40, 1 << 28
LIMIT = (1 << 63) - 1
#: Parts coded together.
RUN = 4096
CODED = T.StructType([T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])


class Cells:
    """A codebook's entries in quantised cells."""

    def __init__(self, entries: np.ndarray, bits: int):
        order = np.sort(entries, axis=0)
        n, cells = len(entries), 1 << bits
        first = order[np.arange(cells) * n // cells]  # of each coordinate: where each cell begins, by rank
        self.entries = entries
        self.cell = np.stack([np.searchsorted(first[:, j], entries[:, j], "right") - 1 for j in range(entries.shape[1])], axis=1)
        self.low, self.high = first.copy(), first.copy()
        for j in range(entries.shape[1]):  # the extent of what is in a cell
            np.maximum.at(self.high[:, j], self.cell[:, j], entries[:, j])

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of squared distances, a row for each query."""
        below, above = self.low[None] - queries[:, None, :], queries[:, None, :] - self.high[None]
        near = np.maximum(np.maximum(below, above), 0) ** 2  # tables: query, cell, coordinate
        far = np.maximum(np.abs(below), np.abs(above)) ** 2
        low, high = 0, 0
        for j in range(queries.shape[1]):
            low, high = low + near[:, self.cell[:, j], j], high + far[:, self.cell[:, j], j]
        return low, high

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index and squared distance of each query's nearest entry, and how many distances were computed."""
        low, high = self.bounds(queries)
        query, entry = np.nonzero(low <= high.min(axis=1, keepdims=True))
        exact = ((queries[query] - self.entries[entry]) ** 2).sum(axis=1)
        begins = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
        least = np.minimum.reduceat(exact, begins)
        first = np.flatnonzero(exact == np.repeat(least, np.diff(np.append(begins, len(query)))))
        first = first[np.append(True, query[first[1:]] != query[first[:-1]])]  # ties: entries come in order
        return entry[first], least, len(query)


class Codebooks:
    """The cells of all parts' codebooks, (parts, entries, width)."""

    def __init__(self, entries: np.ndarray, bits: int):
        self.entries, self.wide = entries, np.abs(entries).max(initial=0) >= SAFE
        self.bits, self.narrow_cells, self.wide_cells = bits, None, None

    def cells(self, wide: bool) -> list[Cells]:
        """Wide ones compute with Python's integers."""
        name = "wide_cells" if wide else "narrow_cells"
        if getattr(self, name) is None:
            setattr(self, name, [Cells(e.astype(object) if wide else e, self.bits) for e in self.entries])
        return getattr(self, name)

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n, parts) of entry indices and of squared distances."""
        parts, _, width = self.entries.shape
        index, error = np.empty((len(vectors), parts), np.int64), np.empty((len(vectors), parts), object)
        for at in range(0, len(vectors), RUN):
            run = vectors[at : at + RUN].reshape(-1, parts, width)
            wide = self.wide or width * np.abs(run).max(initial=0) >= SAFE
            for p, cells in enumerate(self.cells(bool(wide))):
                index[at : at + RUN, p], error[at : at + RUN, p], _ = cells.nearest(run[:, p].astype(object) if wide else run[:, p])
        return index, error


def integers(vector, scale: int):
    """Column: floor(scale x) of a vector's components."""
    scaled = lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-float(MOST))), F.lit(float(MOST)))).cast("long")
    return F.transform(vector, scaled)


def kept(rows: DataFrame, vec_id: str, vector: str, parts: int, scale: int) -> DataFrame:
    """(own, id, q): the rows that are coded, as structs, and their integer vectors."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    good = rows.where(F.col(vector).isNotNull() & finite & (F.size(vector) > 0) & (F.size(vector) % parts == 0))
    q = good.select(F.struct("*").alias("own"), F.col(vec_id).alias("id"), integers(F.col(vector), scale).alias("q"))
    first = q.orderBy(F.col("id").asc_nulls_last(), "q").select(F.size("q").alias("n")).head(1)
    return q.where(F.size("q") == (first[0].n if first else 0))


def matrix_of(batch: pa.ListArray, width: int) -> np.ndarray:
    return batch.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def train(q: DataFrame, parts: int, entries: int, rounds: int, bits: int) -> np.ndarray:
    """The codebooks (parts, entries, width) from integer vectors (id, q)."""
    first = q.orderBy(F.col("id").asc_nulls_last(), "q").limit(entries).select("q").collect()  # the first codebook
    start = np.array([r.q for r in first], np.int64)
    length = start.shape[1]
    width = length // parts
    books = start.reshape(len(start), parts, width).transpose(1, 0, 2).copy()
    sums = [f"s{j}" for j in range(width)]
    schema = "part int, entry int, n long, " + ", ".join(f"{s} long" for s in sums)
    for _ in range(rounds):
        shared = q.sparkSession.sparkContext.broadcast((books, bits))  # codebooks: `entries` vectors

        def partial(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            books = Codebooks(*shared.value)
            total, n = np.zeros(books.entries.shape, np.int64), np.zeros(books.entries.shape[:2], np.int64)
            for batch in batches:
                vectors = matrix_of(batch.column(0), length)
                index, _ = books.assign(vectors)
                for p in range(parts):
                    np.add.at(total[p], index[:, p], vectors[:, p * width : (p + 1) * width])
                    n[p] += np.bincount(index[:, p], minlength=n.shape[1])
            part, entry = np.nonzero(n)
            columns = [part.astype(np.int32), entry.astype(np.int32), n[part, entry], *total[part, entry].T]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["part", "entry", "n", *sums])

        got = q.select("q").mapInArrow(partial, schema).groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(28,0)")).alias(c) for c in sums]).collect()  # parts x entries rows
        for r in got:
            books[r.part, r.entry] = [int(r[s]) // r.n for s in sums]
    return books


def label_errors(coded: DataFrame, heavy: int = 1000) -> DataFrame:
    """``coded`` (own, label, code, error) with label_error, the sum over rows of equal label.

    Labels of more than a ``heavy``-th of all rows, at most as many, meet their rows by a
    broadcast; the rows of others are too few to crowd a task.
    """
    sums = cut(coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LIMIT).cast("decimal(38,0)")).cast("long").alias("label_error"), F.count("*").alias("_n")))
    total = sums.agg(F.sum("_n")).first()[0] or 0
    often = F.broadcast(sums.where(F.col("_n") * heavy >= total).select(F.col("label").alias("_of"), "label_error"))  # at most `heavy` rows
    seldom = sums.where(F.col("_n") * heavy < total).select(F.col("label").alias("_of"), "label_error")
    same = F.col("label").eqNullSafe(F.col("_of"))
    return coded.join(often, same).union(coded.join(often, same, "left_anti").join(seldom, same)).drop("_of")


def compress(
    rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, bits: int = 4,
) -> DataFrame:
    """``rows`` that are coded, without their vector, with code (two hex digits a part), error, label_error and codebooks_sha256."""
    if entries > 256:
        raise ValueError("a part's code has two hex digits")
    new = ["code", "error", "label_error", "codebooks_sha256"]
    rows = rows.drop(*new)
    others = [c for c in rows.columns if c != vector]
    q = cut(kept(rows, vec_id, vector, parts, scale).select(F.struct(*[F.col("own")[c].alias(c) for c in others]).alias("own"), "id", "q"))
    if not q.take(1):
        return q.select("own.*", *[F.lit(None).cast(t).alias(c) for c, t in zip(new, ("string", "long", "long", "string"), strict=True)])
    books = train(q, parts, entries, rounds, bits)
    digest = hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()
    shared = q.sparkSession.sparkContext.broadcast((books, bits))  # codebooks: `entries` vectors
    length = parts * books.shape[2]

    @F.pandas_udf(CODED)
    def code(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Codebooks(*shared.value)
        for batch in batches:
            index, error = own.assign(np.concatenate([np.empty(0, np.int64), *batch]).reshape(-1, length))
            errors = np.minimum(error.sum(axis=1), LIMIT).astype(np.int64) if len(error) else []
            yield pd.DataFrame({"code": [row.astype(np.uint8).tobytes().hex() for row in index], "error": errors})

    coded = cut(q.select("own", F.col("own")[label].alias("label"), code("q").alias("c")).select("own", "label", "c.*"))
    return label_errors(coded).select("own.*", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    """op11: every embedding's code and its errors."""
    return compress(read_table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def oracle_sql(parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> str:
    """DuckDB SQL with the same rows."""
    assign = "SELECT vec_id, p, arg_min(j, (d, j)) AS j, min(d) AS d FROM (SELECT v.vec_id, v.p, b.j, list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - b.x[i]) * (v.x[i] - b.x[i])))::BIGINT AS d FROM v JOIN b{r} b ON v.p = b.p) GROUP BY vec_id, p"
    steps = [
        f"k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"v AS (SELECT vec_id, p, list_slice(q, p * (len(q) // {parts}) + 1, (p + 1) * (len(q) // {parts})) AS x FROM k, (SELECT unnest(range({parts})) AS p))",
        f"b0 AS (SELECT p, j, x FROM v JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS j FROM k ORDER BY vec_id LIMIT {entries}) USING (vec_id))",
    ]
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({assign.format(r=r)})")
        mean = "SELECT p, j, list(m ORDER BY i) AS x FROM (SELECT p, j, i, floor_div AS m FROM (SELECT p, j, i, ((sum(c) - ((sum(c) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS floor_div FROM (SELECT p, j, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM v JOIN a{r} USING (vec_id, p)) GROUP BY p, j, i)) GROUP BY p, j".format(r=r)
        steps.append(f"b{r + 1} AS MATERIALIZED (SELECT b.p, b.j, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN ({mean}) m ON b.p = m.p AND b.j = m.j)")
    steps += [
        f"a AS MATERIALIZED ({assign.format(r=rounds)})",
        "e AS (SELECT vec_id, string_agg(printf('%02x', j), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a GROUP BY vec_id)",
        f"h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, j)) AS digest FROM b{rounds})",
    ]
    return f"WITH {', '.join(steps)} SELECT k.vec_id, e.code, e.error, (sum(e.error) OVER (PARTITION BY k.label))::BIGINT AS label_error, h.digest AS codebooks_sha256 FROM k JOIN e USING (vec_id), h"

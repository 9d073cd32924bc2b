"""Which of a bounded set of markers occur in a chunk, by rolling numbers of bases in numpy.

The number of the k bases from each position follows from that of k - 1. Where a marker
has so many bases, numbers are looked up in a table with a place for each of the 4 ** k;
a marker of more than ``HEAD`` bases is searched for only in chunks that have its head.
What leaves a task is one row for a chunk, or one for a chunk's distinct hit, never one for
a position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presentia.functions.dna import base_codes
from presentia.operators.seeding import CODE, ROW

#: Longest marker that is looked up whole; a table of 2 bytes for each number of its bases.
HEAD = 10
#: Bases, and cells of (chunk, marker), that are handled together.
RUN, CELLS = 1 << 18, 1 << 22


def lots(chunks: pa.Array, rows: int) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, chunks) of some chunks in a row: about RUN bases, ``rows`` of them at most."""
    sizes = np.cumsum(pc.binary_length(chunks).to_numpy(zero_copy_only=False), dtype=np.int64)
    edges = np.flatnonzero(np.diff(sizes // RUN, prepend=0) | (np.arange(len(sizes)) % rows == 0))
    edges = np.unique(np.append(0, edges))
    for a, b in zip(edges, np.append(edges[1:], len(sizes)), strict=True):
        if a < b:
            yield int(a), chunks.slice(a, b - a).cast(pa.large_binary()).to_pylist()


def rolling(texts: list[bytes], longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For k from 1 to ``longest``: k, the number of the k bases from each position, whether they are bases of one text, and each position's text."""
    base = CODE[np.frombuffer(b"N".join(texts), np.uint8)]
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])[: len(base)]
    digit, valid = (base & 3).astype(np.uint32), base < 4
    number, ok = np.zeros(len(base), np.uint32), np.ones(len(base), bool)
    for k in range(1, min(longest, len(base)) + 1):
        number = number[: len(base) - k + 1] << np.uint32(2) | digit[k - 1 :]
        ok = ok[: len(number)] & valid[k - 1 :]
        yield k, number, ok, owner[: len(number)]


def _number(seq: str) -> int:
    return int(seq.translate(str.maketrans("ACGT", "0123")), 4)


def found(pieces: DataFrame, markers: list[str | None]) -> DataFrame:
    """(genome_id, words): a row for each genome with a bit for each of the valid ``markers``, in 64-bit words; words of several chunks are joined. None is never found."""
    ids: dict[int, list[str]] = {}
    for head in dict.fromkeys(m[:HEAD] for m in markers if m):
        ids.setdefault(len(head), []).append(head)
    heads = [h for k in sorted(ids) for h in ids[k]]
    place = {h: i for i, h in enumerate(heads)}
    n, n_words = len(heads), -(-len(markers) // 64)
    whole = np.array([place[m[:HEAD]] if m else n for m in markers])
    long = [(i, m.encode()) for i, m in enumerate(markers) if m and len(m) > HEAD]

    def seen_in(texts: list[bytes], tables: dict[int, np.ndarray]) -> np.ndarray:
        seen = np.zeros(len(texts) * (n + 1), bool)
        for k, number, ok, owner in rolling(texts, max(ids, default=0)):
            if k in tables:
                which = tables[k][number]
                at = np.flatnonzero((which >= 0) & ok)
                seen[owner[at] * (n + 1) + which[at]] = True
        out = seen.reshape(-1, n + 1)[:, whole]
        for i, m in long:
            for row in np.flatnonzero(out[:, i]):
                out[row, i] = m in texts[row]
        return out

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {}
        for k, of in ids.items():
            tables[k] = np.full(4**k, -1, np.int16)
            tables[k][[_number(h) for h in of]] = [place[h] for h in of]
        for batch in batches:
            pa.default_memory_pool().release_unused()  # what batches before have left
            for a, texts in lots(batch.column("chunk"), max(1, CELLS // len(markers))):
                bits = np.zeros((len(texts), n_words * 64), np.uint8)
                bits[:, : len(markers)] = seen_in(texts, tables)
                words = np.packbits(bits, axis=1, bitorder="little").view("<i8")
                yield pa.RecordBatch.from_arrays([batch.column("genome_id").slice(a, len(texts)), *(pa.array(w) for w in words.T)], names=names)

    names = ["genome_id", *(f"w{i}" for i in range(n_words))]
    each = pieces.select("genome_id", "chunk").mapInArrow(scan, T.StructType([pieces.schema["genome_id"], *(T.StructField(x, T.LongType()) for x in names[1:])]))
    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # words are small, what is made of them isn't
    joined = each.repartition(parts, "genome_id").groupBy("genome_id").agg(*[F.bit_or(x).alias(x) for x in names[1:]])
    return joined.select("genome_id", F.array(*names[1:]).alias("words"))


def ones(words, n: int):
    """Column: the places below ``n`` whose bits are 1."""
    return F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bit_get(F.get(words, F.shiftright(i, 6)), i.bitwiseAND(F.lit(63))) == 1)


def as_bits(words, n: int):
    """Column: the first ``n`` bits as a string of 0 and 1."""
    text = lambda w: F.reverse(F.lpad(F.bin(w), 64, "0"))
    return F.left(F.concat(*[text(F.get(words, F.lit(i))) for i in range(-(-n // 64))]), F.lit(n))


def gram_of(seq):
    """Column: a number for a short marker, told from those of other lengths by a 1 in front."""
    return F.conv(F.concat(F.lit("1"), base_codes(seq)), 4, 10).cast("long")


def grams(pieces: DataFrame, wanted: DataFrame, lengths: list[int]) -> DataFrame:
    """(genome_id, gram), distinct: the numbers of ``wanted`` (gram) that occur; their markers have ``lengths``, 15 at most."""
    size = max(ROW, 2 * 4 ** max(lengths))
    table = np.zeros((size // ROW, ROW // 8), np.uint8)
    rows = wanted.select(F.shiftright("gram", 15).alias("row"), F.col("gram").bitwiseAND(F.lit(ROW - 1)).alias("bit"))
    for r in rows.groupBy("row").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():  # `size` bits in all
        table[r.row] = np.frombuffer(r.bits, np.uint8)
    shared = pieces.sparkSession.sparkContext.broadcast(np.unpackbits(table.ravel(), bitorder="little").view(bool))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, texts in lots(batch.column("chunk"), RUN):
                for k, number, ok, owner in rolling(texts, max(lengths)):
                    if k in lengths:
                        top = 4**k
                        at = np.flatnonzero(shared.value[top : 2 * top][number] & ok)
                        key = np.unique(owner[at] * top + number[at])
                        yield pa.RecordBatch.from_arrays([batch.column("genome_id").take(pa.array(a + key // top)), pa.array(key % top + top)], names=["genome_id", "gram"])

    return pieces.select("genome_id", "chunk").mapInArrow(scan, T.StructType([pieces.schema["genome_id"], T.StructField("gram", T.LongType())])).distinct()

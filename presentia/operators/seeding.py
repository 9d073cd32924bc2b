"""Where markers may begin: seeds of genomes that a table of the markers' seeds lets through.

A seed is ``k`` bases as one number. Rolling seeds of a chunk are tested in numpy against a
bit table of the markers' seeds before any row is made, so that what is joined are starts
near the hits, not a row for every base. With ``w`` > 1 only minimizers are seeds: of each
``w`` seeds in a row the least by a hash, so that about two starts in w + 1 are tested. A
marker's seed is the minimizer of its first w seeds; where the marker occurs, the genome
has the same w seeds and so the same minimizer, and nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Longest seed that fits a long.
LONGEST = 31
#: Bases handled together.
RUN = 1 << 18
#: Bits that a row of the table holds, and the largest table (16 MB) in bits.
ROW, TABLE_BITS = 1 << 15, 27
CODE = np.full(256, 4, np.uint8)
CODE[[ord(b) for b in "ACGT"]] = np.arange(4)


def mixed(x: np.ndarray) -> np.ndarray:
    """The order of minimizers: a hash, so that runs of one base aren't first."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


def seeds_of(data: np.ndarray, stops: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of the k bases from each position, and whether they are bases of one text; ``stops`` has the end of each position's text."""
    code = CODE[data]
    breaks = np.append(0, np.cumsum(code == 4))
    n = len(data)
    at = np.arange(n)
    ok = at + k <= stops
    ok[ok] = breaks[at[ok] + k] == breaks[at[ok]]
    value, size, power, done = np.zeros(n, np.uint64), 0, (code & 3).astype(np.uint64), 1
    for bit in range(k.bit_length()):  # by doubling
        if k >> bit & 1:
            value = (value << np.uint64(2 * done)) | np.append(power, np.zeros(size, np.uint64))[size : size + n] if size else power.copy()
            size += done
        power = (power << np.uint64(2 * done)) | np.append(power[done:], np.zeros(min(done, n), np.uint64))[:n]
        done *= 2
    return value, ok


def _slide(x: np.ndarray, w: int, pick, fill) -> np.ndarray:
    """pick over x[i : i + w], by doubling."""
    out, size = x, 1
    while size < w:
        step = min(size, w - size)
        out = pick(out, np.append(out[step:], np.full(min(step, len(out)), fill, x.dtype)))
        size += step
    return out


def minimizers(value: np.ndarray, ok: np.ndarray, stops: np.ndarray, k: int, w: int) -> np.ndarray:
    """Which positions are the least of some w seeds in a row, all of them valid; equal ones all are."""
    top = np.uint64(2**64 - 1)
    order = np.where(ok, (mixed(value) >> np.uint64(1)) + np.uint64(1), top)  # 0: no window
    whole = _slide(np.where(ok, 0, 1).astype(np.uint8), w, np.maximum, 1) == 0
    least = np.where(whole & (np.arange(len(value)) + k + w - 1 <= stops), _slide(order, w, np.minimum, top), np.uint64(0))
    best = _slide(least[::-1], w, np.maximum, np.uint64(0))[::-1]  # over the windows that a position is in
    return ok & (order == best) & (best > 0)


def _batch(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def marker_seeds(markers: DataFrame, k: int, w: int) -> DataFrame:
    """``markers`` (seq, ...) of k + w - 1 bases or more with seed, and shift: where in the marker it begins."""

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = _batch(batch.column("seq"))
            stops = np.repeat(ends[1:], np.diff(ends))
            value, _ = seeds_of(data, stops, k)
            first = ends[:-1]
            order = np.stack([mixed(value[first + i]) >> np.uint64(1) for i in range(w)]) if len(first) else np.zeros((w, 0), np.uint64)
            shift = order.argmin(axis=0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value[first + shift].view(np.int64)), pa.array(shift.astype(np.int32))], names=[*batch.schema.names, "seed", "shift"])

    return markers.mapInArrow(seeds, T.StructType([*markers.schema.fields, T.StructField("seed", T.LongType()), T.StructField("shift", T.IntegerType())]))


def table_of(seeds: DataFrame) -> np.ndarray:
    """A bit table of seeds: 16 bits for each, 2 ** TABLE_BITS at most."""
    size = max(ROW, 1 << min(TABLE_BITS, (16 * seeds.count()).bit_length()))
    place = F.col("seed").bitwiseXOR(F.shiftrightunsigned("seed", 29)).bitwiseXOR(F.shiftrightunsigned("seed", 43)).bitwiseAND(F.lit(size - 1))
    rows = seeds.select(F.shiftright(place, 15).alias("row"), place.bitwiseAND(F.lit(ROW - 1)).alias("bit"))
    bits = np.zeros((size // ROW, ROW // 8), np.uint8)
    for r in rows.groupBy("row").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():  # `size` bits in all
        bits[r.row] = np.frombuffer(r.bits, np.uint8)
    return bits.ravel()


def passes(bits: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    at = (seeds ^ (seeds >> np.uint64(29)) ^ (seeds >> np.uint64(43))) & np.uint64(8 * len(bits) - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def starts(pieces: DataFrame, bits: np.ndarray, k: int, w: int, width: int) -> DataFrame:
    """(genome_id, chunk_no, seed, before, around) of the seeds of (genome_id, chunk_no, chunk) that pass: ``around`` has ``before`` bases, w - 1 at most, and the ``width`` from the seed on."""
    shared = pieces.sparkSession.sparkContext.broadcast(bits)  # 16 MB at most
    fields = [pieces.schema["genome_id"], pieces.schema["chunk_no"], T.StructField("seed", T.LongType()), T.StructField("before", T.IntegerType()), T.StructField("around", T.StringType())]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pa.default_memory_pool().release_unused()  # what batches before have left
            data, ends = _batch(batch.column("chunk"))
            lots = np.append(0, np.flatnonzero(np.diff(ends[1:] // RUN)) + 1)
            for a, b in zip(lots, np.append(lots[1:], len(ends) - 1), strict=True):
                own, base = data[ends[a] : ends[b]], ends[a]
                owner = np.repeat(np.arange(a, b), np.diff(ends[a : b + 1]))
                stops = ends[owner + 1] - base
                value, ok = seeds_of(own, stops, k)
                ok = minimizers(value, ok, stops, k, w) if w > 1 else ok
                at = np.flatnonzero(ok)
                at = at[passes(shared.value, value[at])]
                before = np.minimum(at - (ends[owner[at]] - base), w - 1)
                text = own.tobytes().decode("ascii")
                around = [text[x:y] for x, y in zip((at - before).tolist(), np.minimum(at + width, stops[at]).tolist(), strict=True)]
                which = pa.array(owner[at])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("genome_id").take(which), batch.column("chunk_no").take(which), pa.array(value[at].view(np.int64)), pa.array(before.astype(np.int32)), pa.array(around, pa.string())], names=[f.name for f in fields]
                )

    return pieces.select("genome_id", "chunk_no", "chunk").mapInArrow(find, T.StructType(fields))

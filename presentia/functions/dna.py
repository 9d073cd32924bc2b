"""Column functions over nucleotide text and presence bits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VALID = "^[ACGT]+$"

LETTERS = np.frombuffer(b"ACGTN", np.uint8)
DIGITS = np.full(256, 4, np.uint8)
DIGITS[LETTERS] = np.arange(5)


def normalise(seq: Column, upper: bool = True) -> Column:
    """A genome's text with every run of anything but A, C, G, T as one N, the break. Null becomes empty."""
    seq = F.coalesce(seq, F.lit(""))
    return F.regexp_replace(F.upper(seq) if upper else seq, "[^ACGT]+", "N")


def as_bases(text: Column, letters: dict[str, str], mark: str = "N") -> Column:
    """A text with ``letters`` (of ASCII) mapped to bases, and every run of anything else as one ``mark``. Null becomes empty."""
    table = bytearray(b" " * 256)
    for letter, base in letters.items():
        table[ord(letter)] = ord(base)
    table, mark = bytes(table), mark.encode()

    def clean(text: bytes) -> bytes:
        text = text.translate(table)
        runs = text.split()
        if not runs:
            return mark if text else b""
        return (mark if text[0] == 32 else b"") + mark.join(runs) + (mark if text[-1] == 32 else b"")

    @F.arrow_udf(T.StringType())
    def cleaned(texts: pa.Array) -> pa.Array:
        pa.default_memory_pool().release_unused()  # what batches before have left
        return pa.array([clean(t.as_buffer().to_pybytes()) if t.is_valid else b"" for t in texts], pa.binary()).cast(pa.string())

    return cleaned(text)


def clean_fasta(text: Column) -> Column:
    """The sequence of a FASTA text: header lines dropped, the others upper-cased and joined."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda x: ~F.startswith(x, F.lit(">")))
    return F.upper(F.array_join(lines, ""))


def collapse_breaks(seq: Column) -> Column:
    """Runs of N as one N."""
    return F.regexp_replace(seq, "N+", "N")


def segments(seq: Column) -> Column:
    """The non-empty stretches between breaks."""
    return F.filter(F.split(seq, "N+"), lambda x: x != "")


def is_valid_marker(seq: Column) -> Column:
    """Whether a marker can match at all; the empty one and one with another letter can't."""
    return F.coalesce(seq.rlike(VALID), F.lit(False))


def base_codes(seq: Column) -> Column:
    """A, C, G, T as digits 0 to 3."""
    return F.translate(seq, "ACGT", "0123")


def _spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column's texts, and where each begins and the last ends."""
    column = column.fill_null("").cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def _lists(ends: np.ndarray, values: pa.Array, like: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values, mask=like.is_null() if like.null_count else None)


def pack3(seq: Column) -> Column:
    """Three bases a number: two bits each from the highest, and in the lowest two how many are missing at the end."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def packed(texts: pa.Array) -> pa.Array:
        data, ends = _spans(texts)
        sizes = np.diff(ends)
        last = np.append(0, np.cumsum(-(-sizes // 3)))
        digits = np.zeros(3 * last[-1], np.uint8)
        digits[np.arange(len(data)) + np.repeat(3 * last[:-1] - ends[:-1], sizes)] = DIGITS[data] & 3
        numbers = digits.reshape(-1, 3) @ np.array([64, 16, 4], np.int32)
        some = sizes > 0
        numbers[last[1:][some] - 1] += (-sizes % 3)[some]
        return _lists(last, pa.array(numbers.astype(np.int32)), texts)

    return packed(seq)


def unpack3(packed: Column) -> Column:
    """The bases that pack3 packed."""

    @F.arrow_udf(T.StringType())
    def bases(lists: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        numbers = lists.flatten().to_numpy(zero_copy_only=False)
        three = LETTERS[np.stack([numbers >> 6 & 3, numbers >> 4 & 3, numbers >> 2 & 3], axis=1)]
        n = 3 - (numbers & 3)
        text = three[np.arange(3) < n[:, None]].tobytes()
        ends = np.append(0, np.cumsum(n))[np.append(0, np.cumsum(sizes))].tolist()
        there = lists.is_valid().to_pylist()
        return pa.array([text[a:b] if x else None for a, b, x in zip(ends[:-1], ends[1:], there, strict=True)], pa.binary()).cast(pa.string())

    return bases(packed)


def pack_genome(seq: Column) -> Column:
    """A whole genome, breaks included, as a struct: triples (a byte for each three of A, C, G, T, N, as a number to the base of five) and length."""

    @F.arrow_udf(T.BinaryType())
    def triples(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts:
            digits = DIGITS[np.frombuffer((text.as_py() or "").encode(), np.uint8)]
            three = np.append(digits, np.zeros(-len(digits) % 3, np.uint8)).reshape(-1, 3)
            out.append((three @ np.array([25, 5, 1], np.uint8)).astype(np.uint8).tobytes())
        return pa.array(out, pa.binary())

    return F.struct(triples(seq).alias("triples"), F.coalesce(F.length(seq), F.lit(0)).alias("length"))


def unpack_genome(packed: Column) -> Column:
    """The genome that pack_genome packed; a letter other than A, C, G, T is N."""

    @F.arrow_udf(T.StringType())
    def bases(triples: pa.Array) -> pa.Array:
        out = []
        for x in triples:
            number = np.frombuffer(x.as_py(), np.uint8)
            out.append(LETTERS[np.stack([number // 25, number // 5 % 5, number % 5], axis=1)].tobytes().decode())
        return pa.array(out, pa.string())

    return F.left(bases(packed["triples"]), packed["length"])


def one_hot(seq: Column) -> Column:
    """Four rows of 0 and 1 for A, C, G and T; a break is 0 in all."""

    def row(base: str) -> Column:
        @F.arrow_udf(T.ArrayType(T.ByteType()))
        def bits(texts: pa.Array) -> pa.Array:
            data, ends = _spans(texts)
            if len(data) and data.max() > 127:  # a letter is one bit, however many bytes it has
                first = (data & 0xC0) != 0x80
                data, ends = data[first], np.append(0, np.cumsum(first))[ends]
            return _lists(ends, pa.array((data == ord(base)).view(np.int8)), texts)

        return bits(seq).alias(base.lower())

    return F.struct(*[row(b) for b in "ACGT"])


def from_one_hot(rows: Column) -> Column:
    """The text of a one-hot genome: the first row that is set, N where none is; as long as its row for A."""

    @F.arrow_udf(T.StringType())
    def letters(a: pa.Array, c: pa.Array, g: pa.Array, t: pa.Array) -> pa.Array:
        out = []
        for i in range(len(a)):
            text = np.full(len(a[i].values) if a[i].is_valid else 0, ord("N"), np.uint8)
            for base, row in zip(b"TGCA", (t, g, c, a), strict=True):
                if row[i].is_valid:
                    one = row[i].values.fill_null(0).to_numpy(zero_copy_only=False)[: len(text)] != 0
                    text[: len(one)][one] = base
            out.append(text.tobytes())
        return pa.array(out, pa.binary()).cast(pa.string())

    return letters(*[rows[b] for b in "acgt"])


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def without_prefix(path: Column, prefix: str) -> Column:
    """A manifest's entry without ``prefix``, where it begins with it."""
    return F.when(F.startswith(path, F.lit(prefix)), F.substring(path, F.lit(len(prefix) + 1), F.length(path))).otherwise(path)


def is_clean(text: Column) -> Column:
    """Whether a file's text is a cleaned genome already: one line, and so no FASTA."""
    return ~F.contains(F.coalesce(text, F.lit("")), F.lit("\n"))


def after_comma(line: Column) -> Column:
    """What follows the first comma; the whole line if there is none."""
    return F.substring(line, F.locate(",", line) + 1, F.length(line))


def second_field(line: Column) -> Column:
    return F.split_part(line, F.lit(","), F.lit(2))


def last_field(line: Column) -> Column:
    return F.element_at(F.split(line, ","), -1)


def bits_of(ordinals: Column, width: Column) -> Column:
    """A string of ``width`` bits with 1 at the given positions, in one pass over the sorted positions."""
    before = lambda o, i: F.coalesce(F.get(o, i - 1), F.lit(-1))
    run = lambda o: lambda x, i: F.concat(F.repeat(F.lit("0"), (x - before(o, i) - 1).cast("int")), F.lit("1"))

    def fill(o: Column) -> Column:
        last = F.coalesce(F.get(o, F.size(o) - 1), F.lit(-1))
        return F.concat(F.array_join(F.transform(o, run(o)), ""), F.repeat(F.lit("0"), (width - last - 1).cast("int")))

    return F.get(F.transform(F.array(F.array_sort(ordinals)), fill), F.lit(0))


def ones_of(bits: Column) -> Column:
    """Positions of the 1s of a bit string."""
    each = F.transform(F.filter(F.split(bits, ""), lambda x: x != ""), lambda x, i: F.when(x == "1", i))
    return F.filter(each, lambda x: x.isNotNull())

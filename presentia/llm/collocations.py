"""Operator 12: phrase collocation mining over vertical positional inverted lists.

Documents are taken in blocks, each as an inverted file of its own: for every word the
sorted positions of its occurrences. A phrase's list has the positions where it begins,
so its length is the phrase's exact frequency in the block. Phrases grow a word at a
time: the list of a frequent phrase is merge-joined with the postings of adjacent words
(a list of positions shifted by the phrase's length), and only where the words that
follow make a frequent phrase as well. A phrase never leaves its document, so lists are
joined where they are; what is shuffled is a list's length for each phrase and block.

A level is counted twice. First every phrase has 64 bits of hash for a name: phrases that
share one are added up, so no count is too low. Those that are frequent by this count set
bits of a filter of ``filter_bits`` at most. The next pass, which extends the lists that
pass the filter, tells their lengths by the phrase itself, and so the exact
frequencies: what passed without being frequent falls out then, and a frequent phrase
always passes. The longest phrases are named at once. Scores are exact: decimals of 38 digits, divided as whole
numbers.

Defined results: null and empty texts have no words; a null language is `und`; a null
id doesn't matter and repeated rows count again; an empty table gives an empty
result; columns other than the text and the language aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presentia.llm.bpe import slice_hashes
from presentia.llm.common import cut, read_table
from presentia.llm.simhash import mix

#: Bytes of texts in a block, about.
BLOCK = 1 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: 1: ends a piece; 2: ends a word.
PARTS = np.zeros(256, np.uint8)
PARTS[[ord(c) for c in ".,;:!?"] + list(range(10, 14))] = 1
PARTS[[9, 32]] = 2
COUNTS = "h long, n long, lang string, phrase string"
#: Bits that a row of a filter holds.
ROW = 1 << 15
ODD = np.uint64(0x9E3779B97F4A7C15)
HALF = np.uint64(32)


def word_hashes(langs: list[str], lang: np.ndarray, words: pa.Array) -> np.ndarray:
    """64 bits for each word of a language."""
    seeds = np.array([xxhash.xxh64_intdigest(x) for x in langs], np.uint64)
    if not len(words):
        return np.empty(0, np.uint64)
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    return mix(slice_hashes(np.frombuffer(words.buffers()[2], np.uint8), ends[:-1], ends[1:]) ^ seeds[lang])


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, and each key's number among them."""
    found = pa.array(keys).dictionary_encode()
    return found.dictionary.to_numpy(zero_copy_only=False), found.indices.to_numpy(zero_copy_only=False).astype(np.int64)


class Block:
    """An inverted file of some documents: occurrences in order, each with a position and its word's number.

    Positions of words that follow each other in a piece differ by one, those of other
    words by more. A list of a word or phrase is those of ``at`` that have its number.
    """

    def __init__(self, langs: pa.Array, texts: pa.Array):
        texts = pc.fill_null(texts, "").cast(pa.large_binary())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        begins = np.zeros(len(data) + 1, bool)
        begins[ends] = True
        kind = PARTS[data]
        inside = np.append(kind == 0, False)
        after = np.append(False, inside[:-1])
        starts = np.flatnonzero(inside & (begins | ~after))
        stops = np.flatnonzero(after & (begins | ~inside))
        pieces = np.cumsum((kind == 1) | begins[:-1], dtype=np.int32)
        letters = np.append(0, np.cumsum(stops - starts)).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(letters), pa.py_buffer(LOWER[data[inside[:-1]]])]).dictionary_encode()
        self.at = np.arange(len(starts)) + (pieces[starts] if len(starts) else 0)
        langs = pc.fill_null(langs, "und").dictionary_encode()
        self.langs = langs.dictionary.to_pylist()
        lang = langs.indices.to_numpy(zero_copy_only=False)[np.searchsorted(ends, starts, "right") - 1].astype(np.int64)
        self.n_words = np.bincount(lang, minlength=len(self.langs))
        number, self.phrase = numbered(lang * max(1, len(words.dictionary)) + words.indices.to_numpy(zero_copy_only=False))
        self.lang, self.names = np.divmod(number, max(1, len(words.dictionary)))
        self.names = words.dictionary.take(pa.array(self.names))
        self.last = self.phrase
        self.hash = self.word_hash = word_hashes(self.langs, self.lang, self.names)
        self.parts = (self.names, np.arange(len(self.names)), None)

    def keep(self, bits: np.ndarray) -> None:
        """Only the lists of phrases that pass a filter."""
        ok = np.ones(len(self.hash), bool)
        for at in (self.hash & np.uint64(8 * len(bits) - 1), (self.hash >> HALF) & np.uint64(8 * len(bits) - 1)):
            ok &= (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        stays, which = ok[self.phrase], np.flatnonzero(ok)
        self.parts = (self.texts(which), np.arange(len(which)), None)
        self.at, self.last, self.phrase = self.at[stays], self.last[stays], (np.cumsum(ok) - 1)[self.phrase[stays]]
        self.lang, self.hash = self.lang[which], self.hash[which]

    def texts(self, which: np.ndarray) -> pa.Array:
        begin, first, word = self.parts
        out = begin.take(pa.array(first[which]))
        return out if word is None else pc.binary_join_element_wise(out, self.names.take(pa.array(word[which])), pa.scalar(" ", pa.large_string()))

    def extend(self) -> None:
        """Lists of phrases longer by a word: a phrase's list, shifted by one, merged with those of the phrases that overlap it in all but a word."""
        if not len(self.at):
            return
        follows = np.searchsorted(self.at, self.at + 1)
        follows[follows == len(self.at)] = 0
        here = np.flatnonzero(self.at[follows] == self.at + 1)
        last = self.last[follows[here]]
        pair, phrase = numbered(self.phrase[here] * len(self.names) + last)
        first, word = np.divmod(pair, len(self.names))
        self.parts = (self.parts[0], first, word)
        self.at, self.last, self.phrase = self.at[here], last, phrase
        self.lang, self.hash = self.lang[first], mix(self.hash[first] * ODD + self.word_hash[word])

    def lengths(self) -> np.ndarray:
        """The length of every list."""
        return np.bincount(self.phrase, minlength=len(self.hash))

    def rows(self, named: bool) -> pa.RecordBatch:
        """A row for each phrase with its list's length; it is named by itself, or by its hash."""
        n, none = len(self.hash), pa.nulls
        names = [none(n, pa.int64()), pa.array(self.langs, pa.string()).take(pa.array(self.lang)), self.texts(np.arange(n)).cast(pa.string())]
        names = names if named else [pa.array(self.hash.view(np.int64)), none(n, pa.string()), none(n, pa.string())]
        return pa.RecordBatch.from_arrays([names[0], pa.array(self.lengths().astype(np.int64)), *names[1:]], names=["h", "n", "lang", "phrase"])

    def totals(self) -> pa.RecordBatch:
        """The number of words of each language."""
        n = len(self.langs)
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(self.n_words.astype(np.int64)), pa.array(self.langs, pa.string()), pa.nulls(n, pa.string())], names=["h", "n", "lang", "phrase"])


def filter_of(frequent: DataFrame, filter_bits: int, keep=lambda rows: rows) -> np.ndarray:
    """The bits of a filter of hashes (h), two for each: 32 bits for each at least, 2 ** ``filter_bits`` at most; ``keep`` can be cut(), which drops the shuffle files of its rows."""
    size = max(ROW, 1 << min(filter_bits, (32 * frequent.count()).bit_length()))
    places = F.array(*[x.bitwiseAND(F.lit(size - 1)) for x in (F.col("h"), F.shiftrightunsigned("h", 32))])
    place = frequent.select(F.explode(places).alias("place"))
    rows = place.select(F.shiftright("place", 15).alias("row"), F.col("place").bitwiseAND(F.lit(ROW - 1)).alias("bit"))
    bits = np.zeros((size // ROW, ROW // 8), np.uint8)
    for r in keep(rows.groupBy("row").agg(F.bitmap_construct_agg("bit").alias("bits"))).toLocalIterator():  # `size` bits in all
        bits[r.row] = np.frombuffer(r.bits, np.uint8)
    return bits.ravel()


def counts(docs: DataFrame, filters: list, longest: int) -> DataFrame:
    """(h, n, lang, phrase): numbers of occurrences in (lang, text).

    Rows with h count phrases of len(filters) + 1 words whose shorter phrases pass the
    filters; rows with a phrase count the longest of these themselves, and those of ``longest``
    words, of which there are few, at once; the first time, rows with neither count the words of a language.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            edges = np.append(0, np.flatnonzero(np.diff(sizes // BLOCK)) + 1)
            for a, b in zip(edges, np.append(edges[1:], len(sizes)), strict=True):
                block = Block(batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a))
                if not filters:
                    yield block.totals()
                for i, bits in enumerate(filters, 1):
                    block.keep(bits.value)
                    if i == len(filters):
                        yield block.rows(named=True)
                    block.extend()
                if len(block.at):
                    yield block.rows(named=len(filters) + 1 == longest)
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(count, COUNTS).groupBy("h", "lang", "phrase").agg(F.sum("n").alias("n"))


def cuts(phrase, longest: int):
    """Column: an array of (k, first, rest), a phrase cut after each of its words but the last."""
    words = F.split(phrase, " ")
    parts = lambda k: F.struct(F.lit(k).alias("k"), F.array_join(F.slice(words, 1, k), " ").alias("first"), F.array_join(F.slice(words, F.lit(k + 1), F.size(words)), " ").alias("rest"))
    return F.array_compact(F.array(*[F.when(F.size(words) > k, parts(k)) for k in range(1, longest)]))


def inner_phrases(phrase, longest: int):
    """Column: the shorter phrases of two words or more that lie in a phrase."""
    words = F.split(phrase, " ")
    each = [F.when(F.size(words) >= max(i + n, n + 1), F.array_join(F.slice(words, i + 1, n), " ")) for n in range(2, longest) for i in range(longest - n + 1)]
    return F.array_distinct(F.array_compact(F.array(*each)))


def top(rows: DataFrame, most: int, salts: int = 32) -> DataFrame:
    """Of each lang the first ``most`` by score, a, phrase, with their rank; first among rows dealt out by a hash, then among those left."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    nth = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    some = dealt.withColumn("_nth", nth("lang", "_salt")).where(F.col("_nth") <= most).drop("_salt", "_nth")
    return some.withColumn("rank", nth("lang")).where(F.col("rank") <= most)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 3, least: int = 10, inside: int = 50, most: int = 2000, filter_bits: int = 28) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to ``longest`` words.

    ``least`` is a candidate's frequency at least; one inside a longer candidate that has
    ``inside`` percent of its frequency is dropped.
    """
    docs = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    levels, filters = [], []
    for k in range(longest):
        found = cut(counts(docs, filters, longest).where((F.col("n") >= least) | F.col("h").isNull() & F.col("phrase").isNull()))
        if k == 0:
            totals = found.where("h IS NULL").select("lang", "n")
        else:
            levels.append(found.where("phrase IS NOT NULL").select("lang", "phrase", "n"))
        if k < longest - 1:
            filters.append(docs.sparkSession.sparkContext.broadcast(filter_of(found.where("h IS NOT NULL"), filter_bits)))  # 2 ** filter_bits bits at most
    all_levels = reduce(DataFrame.union, levels)
    candidates = all_levels.where("phrase LIKE '% %'")
    size = lambda part, n: all_levels.select(F.col("lang").alias("_lang"), F.col("phrase").alias(f"_{part}"), F.col("n").alias(n))
    each = candidates.select("lang", "phrase", F.col("n").alias("a"), F.explode(cuts(F.col("phrase"), longest)).alias("c"))
    for part, n in (("first", "l"), ("rest", "r")):
        other = size(part, n)
        each = each.join(other, (each["lang"] == other["_lang"]) & (F.col(f"c.{part}") == other[f"_{part}"])).drop("_lang", f"_{part}")
    exact = "cast({} as decimal(19,0))"
    score = F.expr(f"({exact.format('a')} * {exact.format('a')} * 1000000) div ({exact.format('l')} * {exact.format('r')})").cast("long")
    each = each.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "c.k", "l", "r")).alias("x"))
    each = each.select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    longer = candidates.select("lang", F.col("n"), F.explode(inner_phrases(F.col("phrase"), longest)).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("n").alias("_n"))
    kept = each.join(longer, ["lang", "phrase"], "left").where(F.col("_n").isNull() | (100 * F.col("_n") < inside * F.col("a"))).drop("_n")
    best = cut(top(kept, most))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op12: every language's best phrases."""
    return collocations(read_table(spark, sf_dir, "documents"))


def oracle_sql(least: int = 10, inside: int = 50, most: int = 2000) -> str:
    """DuckDB SQL with the same rows."""
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return (
        f"WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({lowered}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents), "
        "w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p), "
        "g AS (SELECT lang, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS phrase FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k))), "
        "f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS c FROM g GROUP BY lang, k, phrase), "
        f"c2 AS (SELECT lang, phrase, c AS a, string_split(phrase, ' ') AS ws, k FROM f WHERE k > 1 AND c >= {least}), "
        "s AS (SELECT lang, phrase, a, ws, k, i, array_to_string(list_slice(ws, 1, i), ' ') AS p1, array_to_string(list_slice(ws, i + 1, k), ' ') AS p2 FROM (SELECT *, unnest(range(1, k)) AS i FROM c2)), "
        f"t AS (SELECT s.*, f1.c AS l, f2.c AS r, (1000000::HUGEINT * a * a) // (f1.c::HUGEINT * f2.c) AS score FROM s JOIN f f1 ON f1.lang = s.lang AND f1.phrase = p1 AND f1.k = i JOIN f f2 ON f2.lang = s.lang AND f2.phrase = p2 AND f2.k = s.k - i), "
        "u AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) AS nth FROM t), "
        "x AS (SELECT lang, inner_phrase, max(a) AS most FROM (SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS inner_phrase FROM c2 WHERE k = 3) GROUP BY ALL), "
        f"y AS (SELECT u.lang, u.phrase, u.a, u.l, u.r, u.score FROM u LEFT JOIN x ON u.lang = x.lang AND u.phrase = x.inner_phrase WHERE u.nth = 1 AND (u.k = 3 OR x.most IS NULL OR 100 * x.most < {inside} * u.a)), "
        "z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM y) "
        f"SELECT z.lang, z.rank, z.phrase, z.a, z.l, z.r, m.n, z.score::BIGINT AS score FROM z JOIN (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang) m ON z.lang = m.lang WHERE z.rank <= {most}"
    )

"""Operator 7: a quality classifier by an interpolated modified Kneser-Ney model.

A word bigram model is trained on one half of the trusted documents, by a hash of the id,
all of them. Its counts are grouped and joined in Spark: pairs with their contexts'
totals and with the continuation counts of their words give each pair's discounted
probability p, each context's backoff and each word's share of continuations.

A document's log10 probability is a sum over its counts. A token adds the logarithms of
its word's share and of its context's backoff, and where the pair was seen in training
what p differs from their product. So the model is one table (key, a, b) whose keys are
words (a: share, b: backoff) and seen pairs (a: the difference), and a document is a
list of keys, hashes of 56 bits, with counts. Both are sharded by key. A block of texts
asks each shard for its distinct keys, once for all its texts; the join with the shards
answers with their values, and a second join, by block, brings these to the block's counts.
So what is sent grows with the text, however many shards there are. A shard is repeated
for every ``TASK_BYTES`` of text that it has, so no task has more than a shard and
the keys of so much text. Keys that can't be in the model by a bit filter, of 2 ** 27
bits at most, aren't sent.

Seen pairs get their probabilities, and documents are scored, in up to ``ROUNDS`` parts one
after the other, by a hash, so that only a part's shuffle files are on disk at once.

A document has two numbers: its perplexity, and its novelty, the same surprise (log10
a token) with each distinct pair of the text counted once, as what a text repeats is no
news. The other half of the trusted documents, all of them, give each language exact
quantiles of both, as what a model was trained on is no surprise to it. A document outside the perplexities, or below the novelty, is
rejected: words said over and over have no novelty, however rare or common they are.

Defined results: a null or empty text is its end token alone; a null language, or
one with fewer than ``least`` trusted documents, takes the thresholds of all; a
null id is scored and never trusted; repeated rows score alike; with no trusted
documents everything is kept; an empty table gives an empty result. The result has
the id, the language and the columns of classify(), no others.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from presentia.llm.collocations import filter_of, numbered
from presentia.llm.common import Scratch, cut, read_table
from presentia.llm.pitman_yor import LOWER, pack, tokens_of, unpack
from presentia.llm.simhash import mix

BEGIN = np.uint64(1)
#: Characters of a block of texts, about: the larger, the fewer keys are sent more than once.
RUN = 1 << 22
#: Characters of it that are counted at once.
PIECE = 1 << 20
PAIRS = T.StructType([T.StructField("u", T.LongType()), T.StructField("w", T.LongType()), T.StructField("c", T.LongType())])
#: Parts in which pairs and documents are worked off, one for so much text, and this many at most.
ROUNDS, ROUND_BYTES = 6, 1 << 24
#: Text for which a shard is repeated.
TASK_BYTES = 1 << 25
SUMS = ("tokens", "pairs", "log10", "once")
TABLE = "h long, shard long, a double, b double"
PACKED = "key long, data binary"
ANSWERS = "block long, shard long, data binary"
ODD = np.uint64(0x9E3779B97F4A7C15)
HALF = np.uint64(32)
#: Bits of a key that are kept; the others are zeros and take no room.
KEPT = np.uint64(2**64 - 2**8)
#: The filter's two places are of the key and itself moved by so many bits, as its low ones are zeros.
FOLD = np.uint64(29)


def pairs_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word before, word, text) of every token; the word before a text's first is BEGIN."""
    token, _, owner = tokens_of([(t or "").encode("utf-8", "surrogatepass").translate(LOWER) for t in texts])
    before = np.append(BEGIN, token[:-1])
    before[np.append(True, owner[1:] != owner[:-1])] = BEGIN
    return before, token, owner


def pair_key(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One hash of a pair of words."""
    h = u * np.uint64(0x9E3779B97F4A7C15) ^ (w + np.uint64(0x632BE59BD9B4E019))
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def runs(texts: list[str | None], size: int) -> Iterator[list[str | None]]:
    """Runs of texts of about ``size`` characters."""
    edges = np.append(0, np.flatnonzero(np.diff(np.cumsum([len(t or "") for t in texts]) // size)) + 1)
    for a, b in zip(edges, np.append(edges[1:], len(texts)), strict=True):
        yield texts[a:b]


def give_back() -> None:
    """Returns what Arrow keeps of freed memory to the system, as a worker goes on to other tasks."""
    pa.default_memory_pool().release_unused()


def count_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for run in runs(batch["text"].tolist(), PIECE):
            u, w, _ = pairs_of(run)
            each = pd.DataFrame({"u": u.view(np.int64), "w": w.view(np.int64)})
            yield each.groupby(["u", "w"]).size().reset_index(name="c")
            give_back()


def discounts(counts: DataFrame, c: str) -> list[float]:
    """D1, D2 and D3 from the numbers of items counted 1 to 4 times."""
    row = counts.agg(*[F.sum((F.col(c) == k).cast("long")) for k in (1, 2, 3, 4)]).first()
    n = [0, *(x or 0 for x in row)]
    if not n[1] or not n[2]:
        return [0.5, 0.75, 0.9]
    y = n[1] / (n[1] + 2 * n[2])
    return [min(k - 0.05, max(0.05, k - (k + 1) * y * n[k + 1] / n[k])) if n[k] else 0.5 for k in (1, 2, 3)]


def by_count(c: Column, values) -> Column:
    return F.when(c == 1, values[0]).when(c == 2, values[1]).otherwise(values[2])


def train(trusted: DataFrame, scratch: Scratch | None = None) -> dict:
    """The model's tables from documents (text): probabilities of pairs (u, w, share, backoff, p), backoff of contexts (u, backoff), shares of words (w, share).

    With ``scratch`` the counts lie there, and "free" drops them once the tables have been read.
    """
    keep = scratch or cut
    counted = trusted.select("text").mapInPandas(count_pairs, PAIRS).repartition("u", "w")  # counted once; to add up before they are sent would hold many and join few
    pairs = keep(counted.groupBy("u", "w").agg(F.sum("c").alias("c")))
    d, c = discounts(pairs, "c"), F.col("c")
    contexts = pairs.groupBy("u").agg(F.sum("c").alias("total"), F.sum(by_count(c, [F.lit(x) for x in d])).alias("given"))
    contexts = keep(contexts.select("u", "total", (F.col("given") / F.col("total")).alias("backoff")))
    words = keep(pairs.groupBy("w").agg(F.count("*").alias("n")))
    e = discounts(words, "n")
    all_n, v, given = words.agg(F.sum("n"), F.count("*"), F.sum(by_count(F.col("n"), [F.lit(x) for x in e]))).first()
    if not v:
        return {"v": 0}
    unseen = given / all_n / (v + 1)
    shares = words.select("w", ((F.col("n") - by_count(F.col("n"), [F.lit(x) for x in e])) / all_n + unseen).alias("share"))
    found = pairs.join(contexts, "u").join(shares, "w")
    found = found.select("u", "w", "share", "backoff", ((c - by_count(c, [F.lit(x) for x in d])) / F.col("total") + F.col("backoff") * F.col("share")).alias("p"))
    return {"v": v, "unseen": unseen, "keys": pairs.count() + v, "free": (lambda: scratch.drop(pairs, contexts, words)) if scratch else (lambda: None), "pairs": found, "contexts": contexts.select("u", "backoff"), "words": shares}


def word_key(w: np.ndarray) -> np.ndarray:
    """One hash of a word, unlike those of pairs."""
    return mix(w ^ np.uint64(0xD6E8FEB86659FD93))


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a key; shards are ranges of keys."""
    return ((h >> HALF) * np.uint64(shards) >> HALF).astype(np.int64)


def of_round(k: int, rounds: int, *columns: str) -> Column:
    """Which rows are the ``k``-th of so many parts."""
    return F.pmod(F.xxhash64(F.lit(9), *columns), F.lit(rounds)) == k


def value_tables(model: dict, shard_keys: int, rounds: int = 1) -> tuple[list[DataFrame], int]:
    """The model as rows (h, shard, a, b), in ``rounds`` parts, and the number of shards, of about ``shard_keys`` keys each."""
    log = lambda x: F.log10(F.col(x))
    words = model["words"].join(model["contexts"].withColumnRenamed("u", "w"), "w", "full")
    zero = F.lit(0.0)
    words = words.select(F.lit(False).alias("pair"), F.lit(0).cast("long").alias("u"), "w", F.coalesce(log("share") - F.log10(F.lit(model["unseen"])), zero).alias("a"), F.coalesce(log("backoff"), zero).alias("b"))
    pairs = model["pairs"].select(F.lit(True).alias("pair"), "u", "w", (log("p") - log("share") - log("backoff")).alias("a"), zero.alias("b"))
    shards = max(1, -(-model["keys"] // shard_keys))

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            u, w = (batch[x].to_numpy().astype(np.int64).view(np.uint64) for x in "uw")
            h = np.where(batch["pair"].to_numpy(bool), pair_key(u, w), word_key(w))
            h &= KEPT
            yield pd.DataFrame({"h": h.view(np.int64), "shard": shard_of(h, shards), "a": batch["a"], "b": batch["b"]})
        give_back()

    parts = [pairs.where(of_round(k, rounds, "u", "w")) for k in range(rounds)]
    return [part.mapInPandas(keyed, TABLE) for part in [parts[0].union(words), *parts[1:]]], shards


def pack_shard(rows: pd.DataFrame) -> pd.DataFrame:
    """A shard's keys of one part of the model as one row: sorted keys and their values."""
    h = rows["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    parts = pack(gaps_of(h[order]), *(rows[x].to_numpy()[order].tobytes() for x in "ab"))
    give_back()
    return pd.DataFrame({"key": rows["shard"].iloc[:1], "data": [parts]})


def gaps_of(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as the first, in two halves of 32 bits, and the gaps between them."""
    if not len(keys):
        return np.zeros(0, np.int64)
    return np.concatenate([[keys[0] >> HALF, keys[0] & np.uint64(0xFFFFFFFF)], np.diff(keys)]).astype(np.uint64)


def keys_of(gaps: np.ndarray) -> np.ndarray:
    gaps = gaps.view(np.uint64)
    return np.cumsum(np.append(gaps[0] << HALF | gaps[1], gaps[2:]), dtype=np.uint64) if len(gaps) else gaps


def folded_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The keys of packed shards, as the filter has them."""
    for batch in batches:
        for data in batch["data"]:
            keys = keys_of(unpack(data)[0])
            yield pd.DataFrame({"h": (keys ^ (keys >> FOLD)).view(np.int64)})


def count_keys(texts: list[str | None], bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens of each text, distinct pairs of each, keys, counts) of a block.

    Counts are rows (text, n, times as a word, times as a context) for each key of a text
    that passes the filter, the last two among the text's distinct pairs.
    """
    u, w, owner = pairs_of(texts)
    pair = pair_key(u, w)
    _, which = numbered(mix(pair + owner.astype(np.uint64) * ODD))
    n = np.bincount(which)
    first = np.empty(len(n), np.int64)
    first[which[::-1]] = np.arange(len(which))[::-1]
    pair, u, w, text = pair[first], u[first], w[first], owner[first]
    words = np.concatenate([word_key(w), word_key(u)])
    distinct, which = numbered(mix(words + np.tile(text, 2).astype(np.uint64) * ODD))
    at = np.empty(len(distinct), np.int64)
    at[which] = np.arange(len(which))
    as_word, as_context = np.split(which, 2)
    by = lambda role, weights=None: np.bincount(role, weights=weights, minlength=len(distinct)).astype(np.int64)
    one = np.ones(len(pair), np.int64)
    keys = np.concatenate([pair, words[at]]) & KEPT
    counts = np.stack([
        np.concatenate([text, np.tile(text, 2)[at]]), np.concatenate([n, np.maximum(by(as_word, n), by(as_context, n))]),
        np.concatenate([one, by(as_word)]), np.concatenate([one, by(as_context)]),  # b is 0 for a pair
    ])
    ok = passes(bits, keys ^ (keys >> FOLD))
    return np.bincount(owner, minlength=len(texts)), np.bincount(text, minlength=len(texts)), keys[ok], counts[:, ok]


def count_block(texts: list[str | None], bits: np.ndarray, piece: int = PIECE >> 1) -> tuple[np.ndarray, ...]:
    """count_keys() of a block, some of its texts at a time, as counting takes many times the room of the counts."""
    parts, done = [], 0
    for some in runs(texts, piece):
        parts.append(count_keys(some, bits))
        parts[-1][-1][0] += done
        parts[-1] = (*parts[-1][:-1], parts[-1][-1].astype(np.int32))
        done += len(some)
    return tuple(np.concatenate(x, axis=-1) for x in zip(*parts, strict=True))


def keys_to_shards(filter_bits, shards: int, salts: int):
    """A map over (_id, _lang, text): each block's distinct keys for each shard, and at -1 - block its documents with their counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, nth = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, langs, at = batch["_id"].astype(object).where(batch["_id"].notna(), None).tolist(), batch["_lang"].tolist(), 0
            for texts in runs(batch["text"].tolist(), RUN):
                if not texts:
                    continue
                block, salt, own = (part << 20) + nth, (part + nth) % salts, slice(at, at + len(texts))
                tokens, pairs, keys, counts = count_block(texts, filter_bits.value)
                distinct, which = np.unique(keys, return_inverse=True)
                del keys
                edges = np.searchsorted(shard_of(distinct, shards), np.arange(shards + 1))
                out = [(k + shards * salt, pack(block, k, gaps_of(distinct[a:b]))) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if a < b]
                order = np.argsort(counts[0].astype(np.int64) * max(1, len(distinct)) + which)
                (text, n, as_word, as_context), which = counts[:, order], which[order]
                del counts, order, distinct
                again = np.append(False, text[1:] == text[:-1])[: len(text)]
                steps = which - np.where(again, np.roll(which, 1), 0)  # small numbers
                out.append((-1 - block, pack(edges, np.bincount(text, minlength=len(texts)), steps, n, n - as_word, n - as_context, ids[own], langs[own], tokens, pairs)))
                yield pd.DataFrame(out, columns=["key", "data"])
                del out, text, n, as_word, as_context, which, again, steps
                give_back()
                nth, at = nth + 1, at + len(texts)

    return run


def look_up(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """The join of a shard with the keys that blocks ask for: the places of those it has, and their values; blocks' counts are handed on."""
    names = ["block", "shard", "data"]
    if len(asked) and asked["key"].iloc[0] < 0:
        return pd.DataFrame({"block": -1 - asked["key"], "shard": -1, "data": asked["data"]})
    if not len(own) or not len(asked):
        return pd.DataFrame(columns=names)
    parts, out = [unpack(x) for x in own["data"]], []
    keys = np.concatenate([keys_of(gaps) for gaps, _, _ in parts])
    order = np.argsort(keys)
    keys, a, b = keys[order], *(np.concatenate([np.frombuffer(p[i]) for p in parts])[order] for i in (1, 2))
    for data in asked["data"]:
        block, shard, gaps = unpack(data)
        wanted = keys_of(gaps)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        found = np.flatnonzero(keys[at] == wanted)
        at = at[found]
        out.append((block, shard, pack(np.diff(found, prepend=0), a[at].tobytes(), b[at].tobytes())))
    give_back()
    return pd.DataFrame(out, columns=names)


def add_up(rows: pd.DataFrame) -> pd.DataFrame:
    """The join of a block's counts with the values of its keys: its documents with their sums."""
    own = rows["shard"] < 0
    edges, sizes, steps, n, less_word, less_context, ids, langs, tokens, pairs = unpack(rows["data"][own].iloc[0])
    a, b = np.zeros(edges[-1]), np.zeros(edges[-1])
    for shard, data in zip(rows["shard"][~own], rows["data"][~own], strict=True):
        steps_to, *values = unpack(data)
        at = edges[shard] + np.cumsum(steps_to)
        a[at], b[at] = (np.frombuffer(x) for x in values)
    sums, text = np.append(0, np.cumsum(steps)), np.repeat(np.arange(len(ids)), sizes)
    key = sums[1:] - np.repeat(sums[np.cumsum(sizes) - sizes], sizes)
    a, b = a[key], b[key]
    give_back()
    total = lambda x: np.bincount(text, weights=x, minlength=len(ids))
    return pd.DataFrame({
        "_id": pd.Series(ids, dtype=object), "_lang": pd.Series(langs, dtype=object), "tokens": tokens, "pairs": pairs,
        "log10": total(n * (a + b)), "once": total((n - less_word) * a + (n - less_context) * b),
    })


def among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose _id is one of ``ids`` (_id, distinct).

    A bit filter of the ids, of 2 ** 27 bits at most, goes before the join, so that
    hardly any other texts are shuffled.
    """
    key = F.xxhash64(F.lit(8), "_id")
    bits = docs.sparkSession.sparkContext.broadcast(filter_of(ids.select(key.alias("h")), 27))

    @F.pandas_udf(T.BooleanType())
    def maybe(keys: pd.Series) -> pd.Series:
        return pd.Series(passes(bits.value, keys.to_numpy().view(np.uint64)))

    return docs.where(maybe(key)).join(ids, "_id", "left_semi")


def passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes may be in a filter of filter_of()."""
    size, ok = np.uint64(8 * len(bits) - 1), np.ones(len(h), bool)
    for place in (h & size, (h >> HALF) & size):
        ok &= (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return ok


def quantiles(rows: DataFrame, wanted: dict[str, float]) -> DataFrame:
    """(_lang, _n, a column for each of ``wanted``): exact quantiles by language, and of all rows where _all is true.

    ``wanted`` has a column's share; between two values a quantile is interpolated. Equal
    values are counted first, and the distinct ones sorted in ranges that know how many come
    before them, so no language meets in one task.
    """
    values = F.explode(F.array(*[F.struct(F.lit(i).alias("_which"), F.col(c).alias("_x")) for i, c in enumerate(wanted)]))
    each = rows.select("_lang", values.alias("v")).select(F.explode(F.array(F.lit(True), F.lit(False))).alias("_all"), "_lang", "v.*")
    each = each.withColumn("_lang", F.when(~F.col("_all"), F.col("_lang"))).groupBy("_all", "_lang", "_which", "_x").agg(F.count("*").alias("_c"))
    group, order = ["_all", "_lang", "_which"], ["_all", "_lang", "_which", "_x"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = cut(each.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    sums = spread.groupBy("_part", *group).agg(F.sum("_c").alias("_s"))  # a row for each range and group in it
    own = Window.partitionBy(*group)
    sums = sums.select("_part", *group, F.sum("_s").over(own).alias("_n"), (F.sum("_s").over(own.orderBy("_part")) - F.col("_s")).alias("_before"))
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}")) for c in ["_part", *group]]
    run = Window.partitionBy("_part", *group).orderBy("_x")
    at = spread.withColumn("_to", F.sum("_c").over(run)).alias("t").join(F.broadcast(sums).alias("s"), reduce(Column.__and__, same))
    at = at.select("t._all", "t._lang", "t._which", "_x", "_n", (F.col("_before") + F.col("_to")).alias("_to"), (F.col("_before") + F.col("_to") - F.col("_c")).alias("_from"))
    share = F.element_at(F.array(*[F.lit(float(p)) for p in wanted.values()]), F.col("_which") + 1)
    at = at.withColumn("_at", share * (F.col("_n") - 1))
    # the values at the two places beside it, by how near it is to each
    holds = lambda place: (F.col("_from") <= place) & (place < F.col("_to"))
    low, high = F.floor("_at"), F.ceil("_at")
    near = F.when(holds(low), F.when(low == high, F.lit(1.0)).otherwise(high - F.col("_at"))).otherwise(0.0) + F.when(holds(high) & (low != high), F.col("_at") - low).otherwise(0.0)
    found = at.where(holds(low) | holds(high)).groupBy("_all", "_lang").agg(
        F.max("_n").alias("_n"), *[F.sum(F.when(F.col("_which") == i, near * F.col("_x"))).alias(c) for i, c in enumerate(wanted)]
    )
    return cut(found)  # a row for each language


def score(docs: DataFrame, model: dict, shard_keys: int = 400_000, salt_bytes: int | None = None, rounds: int | None = None) -> DataFrame:
    """(_id, _lang, tokens, log10, once) for each of (_id, _lang, text), by joins of keys with the model's shards.

    The shards are repeated for every ``salt_bytes`` of text, else for TASK_BYTES for each of
    them; ``rounds`` is the number of parts, else by the size of the text.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rounds = rounds or min(ROUNDS, max(1, -(-size // ROUND_BYTES)))
    tables, shards = value_tables(model, shard_keys, rounds)
    packed = reduce(DataFrame.union, [cut(table.groupBy("shard").applyInPandas(pack_shard, PACKED)) for table in tables])
    model["free"]()
    salts = max(1, -(-size // (rounds * (salt_bytes or TASK_BYTES * shards))))
    bits = docs.sparkSession.sparkContext.broadcast(filter_of(packed.select("data").mapInPandas(folded_keys, "h long"), 27, cut))  # 2 ** 27 bits at most
    packed = packed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select((F.col("key") + shards * F.col("salt")).alias("key"), "data")
    of = {f.name: f.dataType for f in docs.schema}
    schema = T.StructType([*(T.StructField(x, of[x]) for x in ("_id", "_lang")), *(T.StructField(x, T.LongType() if x in SUMS[:2] else T.DoubleType()) for x in SUMS)])
    unseen, parts = F.log10(F.lit(model["unseen"])), []
    for k in range(rounds):
        asked = docs.where(of_round(k, rounds, "_id", "text")).mapInPandas(keys_to_shards(bits, shards, salts), PACKED)
        sums = packed.groupBy("key").cogroup(asked.groupBy("key")).applyInPandas(look_up, ANSWERS).groupBy("block").applyInPandas(add_up, schema)
        parts.append(cut(sums.select("_id", "_lang", "tokens", (F.col("log10") + F.col("tokens") * unseen).alias("log10"), (F.col("once") + F.col("pairs") * unseen).alias("once"))))
    return reduce(DataFrame.union, parts)


def classify(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "quality",
    shard_keys: int = 400_000, salt_bytes: int | None = None, low: float = 0.003, high: float = 0.99, slack: float = 1.1, low_novelty: float = 0.005, least: int = 30,
) -> DataFrame:
    """A row for each document: its id, language, n_tokens, perplexity, novelty, lowest, highest, least_novelty, kept."""
    good = labels.where((F.col(label) == 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_id")).distinct()
    good = cut(good.withColumn("_half", F.xxhash64(F.lit(7), "_id") % 2 == 0))
    first, others = good.where("_half").select("_id"), good.where("NOT _half").select("_id")
    names, numbers = ["n_tokens", "perplexity", "novelty", "lowest", "highest", "least_novelty", "kept"], ["perplexity", "novelty", "lowest", "highest", "least_novelty"]
    base = docs.select(F.col(doc_id).alias("_id"), F.col(lang).alias("_lang"), F.col(text).alias("text"))
    named = [F.col("_id").alias(doc_id), F.col("_lang").alias(lang), *names]
    with Scratch(docs.sparkSession) as scratch:
        model = train(among(docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")), first), scratch)
        if not model["v"]:
            return base.withColumns({"n_tokens": F.lit(None).cast("long"), **{c: F.lit(None).cast("double") for c in numbers}, "kept": F.lit(True)}).select(*named)
        per_token = lambda x: F.col(x) / F.col("tokens")
        scored = score(base, model, shard_keys, salt_bytes).withColumns({"n_tokens": F.col("tokens"), "perplexity": F.pow(F.lit(10.0), -per_token("log10")), "novelty": -per_token("once")})
        scored = scored.drop(*SUMS)
    ends = quantiles(scored.join(others, "_id", "left_semi").select("_lang", *(F.col(c).alias(n) for c, n in zip(["perplexity", "perplexity", "novelty"], names[3:6], strict=True))), dict(zip(names[3:6], (low, high, low_novelty), strict=True)))
    wide = [(F.col("lowest") / slack).alias("_lowest"), (F.col("highest") * slack).alias("_highest"), (F.col("least_novelty") / slack).alias("_least_novelty")]
    known = ends.where(~F.col("_all") & (F.col("_n") >= least) & F.col("_lang").isNotNull()).select(F.col("_lang").alias("_of"), *wide)
    any_language = ends.where("_all").select(*wide).first() or dict.fromkeys([f"_{n}" for n in names[3:6]])
    out = scored.join(F.broadcast(known), F.col("_lang") == F.col("_of"), "left")  # a row for each language
    out = out.withColumns({n: F.coalesce(f"_{n}", F.lit(any_language[f"_{n}"]).cast("double")) for n in names[3:6]})
    inside = [F.col("perplexity") >= F.col("lowest"), F.col("perplexity") <= F.col("highest"), F.col("novelty") >= F.col("least_novelty")]
    return out.withColumn("kept", reduce(Column.__and__, [F.coalesce(x, F.lit(True)) for x in inside])).select(*named)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: every document's perplexity and verdict."""
    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))

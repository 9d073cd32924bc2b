"""Operator 13: token counts by overlap resynchronisation.

Texts of up to ``chunk`` code points are counted whole. A longer one is cut into
chunks that overlap by ``overlap``, which are dealt out over the cluster and
encoded apart, each with the offsets of its pre-tokens. A chunk that doesn't begin at a
pre-token may begin wrongly, but the pattern of pre-tokens looks ahead only: where a
pre-token of the text begins, what follows doesn't depend on what was before. So if
the chunk before, which is right up to there, and this one both begin a pre-token at
an offset, this one is right from there on. The chunk before is proven right up
to ``margin`` code points before its end: the pattern looks two code points ahead, and a
special string may be cut off there. Neighbours are spliced at the first such offset
by a join. Texts in which some neighbours have none (a word or a run of spaces longer
than the overlap) are cut again, chunks and overlap four times as large, until all
are spliced or the text is one chunk.

Defined results: null and empty texts have no tokens; a special string inside a text
is one token, as the library's default is; repeated rows and null ids count alike; an
empty table gives an empty result; other columns stay as they are (n_bytes, n_tokens,
over_limit are replaced).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presentia.llm.bpe import Vocabulary, pieces
from presentia.llm.common import cut, read_table

VOCABULARY = "byte_bpe_50k.json"
#: Code points that the pattern of pre-tokens looks ahead, at most: an apostrophe and two letters.
AHEAD = 3
LONGS = T.ArrayType(T.LongType())
CHUNK = T.StructType([T.StructField("row", T.LongType()), T.StructField("nth", T.LongType()), T.StructField("at", T.LongType()), T.StructField("last", T.BooleanType()), T.StructField("part", T.StringType())])
ENCODED = T.StructType([*CHUNK.fields[:2], CHUNK["last"], T.StructField("n", T.LongType()), *(T.StructField(f"{end}_{what}", LONGS) for end in ("head", "tail") for what in ("at", "n"))])


class Counter:
    """Counts the tokens of a tokenizer file's byte-level BPE; special strings are tokens of their own."""

    def __init__(self, content: bytes):
        file = json.loads(content)
        before, model, added = file["pre_tokenizer"], file["model"], file["added_tokens"]
        plain = before["type"] == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and not file["normalizer"] and not model.get("ignore_merges")
        if not plain or any(a[k] for a in added for k in ("lstrip", "rstrip", "single_word", "normalized")):
            raise ValueError("only byte-level BPE with its own pattern, and special strings taken as they are, can be counted")
        shown = {chr(b): b for b in (*range(33, 127), *range(161, 173), *range(174, 256))}  # these bytes stand for themselves
        shown |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if chr(b) not in shown)}
        ranks = {bytes(shown[c] for c in t): i for t, i in model["vocab"].items() if all(c in shown for c in t) and i not in {a["id"] for a in added}}
        order = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if order != sorted(order):
            raise ValueError("merges aren't in the order of their tokens")
        self.vocabulary = Vocabulary(ranks)
        names = sorted((a["content"] for a in added if a["content"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        self.margin = AHEAD + max(map(len, names), default=0)

    def pretokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, first code point and number of tokens of every pre-token, in order."""
        owners, offsets, parts, found = [], [], [], []
        for i, text in enumerate(texts):
            at = 0
            for m in self.special.finditer(text) if self.special else ():
                found.append((i, m.start(), 1))
                owners, offsets, parts = [*owners, i], [*offsets, at], [*parts, text[at : m.start()]]
                at = m.end()
            owners.append(i)
            offsets.append(at)
            parts.append(text[at:] if at else text)
        if not parts:
            return (np.empty(0, np.int64),) * 3
        part, place, word = self.vocabulary.slices(parts)
        owner, at, n = np.array(owners)[part], np.array(offsets)[part] + place, np.diff(self.vocabulary.bounds)[word] if len(word) else np.empty(0, np.int64)
        if found:
            owner, at, n = (np.concatenate([a, b]) for a, b in zip((owner, at, n), np.array(found).T, strict=True))
            order = np.lexsort((at, owner))
            owner, at, n = owner[order], at[order], n[order]
        return owner, at, n

    def count(self, texts: list[str]) -> np.ndarray:
        owner, _, n = self.pretokens(texts)
        return np.bincount(owner, weights=n, minlength=len(texts)).astype(np.int64)


@lru_cache(maxsize=2)
def counter(content: bytes) -> Counter:
    return Counter(content)


def chunks_of(rows: Iterator[pd.DataFrame], chunk: int, overlap: int) -> Iterator[pd.DataFrame]:
    """(row, nth, at, last, part): each (row, text) in chunks, one at a time."""
    for batch in rows:
        for row, text in zip(batch["row"], batch["text"], strict=True):
            n = max(1, -(-(len(text) - overlap) // chunk))
            for k in range(n):
                part = text[k * chunk : (k + 1) * chunk + overlap] if k < n - 1 else text[k * chunk :]
                yield pd.DataFrame({"row": [row], "nth": [k], "at": [k * chunk], "last": [k == n - 1], "part": [part]})


def spliced(long: DataFrame, shared, chunk: int, overlap: int) -> DataFrame:
    """(row, n_tokens) of each (row, text); n_tokens is null where some neighbours have no common boundary."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(shared.value)
        for batch in batches:
            for x in batch.itertuples():
                _, at, n = count.pretokens([x.part])
                done = np.cumsum(n) - n  # tokens before each pre-token
                head = at < (overlap if x.nth else 0)
                tail = (at >= (len(x.part) if x.last else chunk)) & (at <= len(x.part) - count.margin)
                ends = [v for where in (head, tail) for v in (at[where] + x.at, done[where])]
                yield pd.DataFrame([(x.row, x.nth, x.last, int(n.sum()), *ends)], columns=ENCODED.names)

    parts = long.select("row", "text").mapInPandas(lambda rows: chunks_of(rows, chunk, overlap), CHUNK)
    parts = cut(parts.repartition("row", "nth").mapInPandas(encode, ENCODED))
    right = parts.where("nth > 0").select("row", (F.col("nth") - 1).alias("nth"), F.col("head_at").alias("_at"), F.col("head_n").alias("_n"))
    both = parts.where("not last").join(right, ["row", "nth"]).withColumn("splice", F.array_min(F.array_intersect("tail_at", "_at")))
    tokens = lambda at, n: F.get(n, (F.array_position(at, F.col("splice")) - 1).cast("int"))
    inner = both.select("row", (tokens("tail_at", F.col("tail_n")) - tokens("_at", F.col("_n"))).alias("n"))
    each = inner.union(parts.where("last").select("row", "n")).groupBy("row").agg(F.sum("n").alias("n"), F.max(F.col("n").isNull()).alias("failed"))
    return cut(each.select("row", F.when(~F.col("failed"), F.col("n")).alias("n_tokens")))


def count_tokens(docs: DataFrame, text: str = "text", limit: int = 1024, path: str | None = None, chunk: int = 1 << 16, overlap: int = 1 << 11) -> DataFrame:
    """``docs`` with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit); ``path`` names a tokenizer's JSON file."""
    if not 0 < overlap <= chunk:
        raise ValueError("an overlap is positive and no larger than a chunk")
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        content = f.read()
    counter(content)  # refuses a file that can't be counted before any job runs
    shared = docs.sparkSession.sparkContext.broadcast(content)  # a tokenizer file, a few MB

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        whole = counter(shared.value)
        for batch in batches:
            runs = pieces([t or "" for t in batch])
            yield pd.Series(np.concatenate([np.empty(0, np.int64), *(whole.count(run) for run in runs)]))

    docs = docs.drop("n_bytes", "n_tokens", "over_limit")
    size, whole = F.coalesce(F.length(text), F.lit(0)), chunk + overlap
    short = docs.where(size <= whole).withColumn("n_tokens", count(F.col(text)))
    long = cut(docs.where(size > whole).select(F.struct("*").alias("own"), F.monotonically_increasing_id().alias("row")))
    todo, found = long.select("row", F.col("own")[text].alias("text")), []
    while todo.take(1):
        got = spliced(todo, shared, chunk, overlap)
        found.append(got.where("n_tokens IS NOT NULL"))
        todo = todo.join(got.where("n_tokens IS NULL").select("row"), "row", "left_semi")
        chunk, overlap = 4 * chunk, 4 * overlap
    if found:
        short = short.unionByName(long.join(reduce(DataFrame.union, found), "row").select("own.*", "n_tokens"))
    n_bytes = F.octet_length(F.coalesce(text, F.lit(""))).cast("long")
    return short.withColumns({"n_bytes": n_bytes, "over_limit": F.col("n_tokens") > limit})


def query(spark, sf_dir: str) -> DataFrame:
    """op13: token counts of every document."""
    return count_tokens(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "n_tokens", "over_limit")

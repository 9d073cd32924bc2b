"""Operator 1: SimHash near-dedup with Golay-code fuzzy keys.

A document's fingerprint has a bit for each bit of its shingles' hashes: 1 if
over half of them have it. To find fingerprints that differ in few bits, each is
cut into segments of at most 23 bits, and segments are decoded by the perfect
binary Golay code: a segment's keys are the nearest codeword's index and, where
that is 3 bits away, the five at 4 bits. Two segments that differ in 2 bits or
fewer share a key. By pigeonhole, of three segments with 2 differing bits in all
one is equal, and the next has 2 at most: a join key is an equal segment with a
decoded one. Pairs that meet are verified on all bits.

Equal fingerprints are one node throughout. Where a join key has more than
``few`` fingerprints, pairs aren't formed: each fingerprint in such a bucket is
sent to itself and its 64 one-bit neighbours, and all that meet at one place are
within 2 bits of each other, and two within 2 bits always meet; one link from
each to the smallest keeps their component. So nothing is lost or capped, and
rows stay in proportion to fingerprints.

Defined results: a null, empty or blank text has fingerprint zero and is linked
like any other; a null id is carried and never the smallest; repeated rows share
a component; an empty table gives an empty result; other columns stay as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presentia.llm.common import WORD, Scratch, cut, let, read_table, row_hashes

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SEED = 42
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the (23, 12) Golay code.
GENERATOR = 0b101011100011
#: Segments of 64 bits: lowest bit and width.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
SLICE = 1 << 16
SLICE_CHARS = 16 << 20
LONGS = T.ArrayType(T.LongType())


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words of a text's UTF-8; bytes.split() parts at exactly space and tab to carriage return."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def shingles_of(words: list[bytes], n: int) -> list[bytes]:
    """All n-word shingles, repeats included; the whole sequence if there are fewer words."""
    if len(words) <= n:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False)))


def fingerprint(text: str | None, n: int = 3) -> int:
    """The 64-bit SimHash of a text's n-word shingles, as a signed number."""
    words = words_of(text)
    total = max(1, len(words) - n + 1) if words else 0
    ones = np.zeros(64, np.int64)
    for at in range(0, total, SLICE):  # bounded memory for any length
        part = shingles_of(words[at : at + SLICE + n - 1], n)
        bits = np.unpackbits(np.frombuffer(b"".join([xxhash.xxh64_digest(x, SEED) for x in part]), np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total).view(">i8")[0])


def fingerprints(n: int = 3):
    """A column function: the fingerprints of a text column."""

    @F.pandas_udf(T.LongType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, n) for t in texts], dtype="int64")

    return of


@cache
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits; for each syndrome its error patterns: the lightest, then (-1 if none) those of weight 4."""

    def rest(x: int) -> int:
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= GENERATOR << (i - 11)
        return x

    unit = [rest(1 << i) for i in range(23)]
    patterns = np.full((2048, 6), -1, np.int64)
    low = np.array([np.bitwise_xor.reduce([unit[i] for i in range(12) if x >> i & 1] or [0]) for x in range(4096)])
    high = np.array([np.bitwise_xor.reduce([unit[i + 12] for i in range(11) if x >> i & 1] or [0]) for x in range(2048)])
    for w in (0, 1, 2, 3, 4):
        for places in combinations(range(23), w):
            x = sum(1 << i for i in places)
            s = low[x & 4095] ^ high[x >> 12]
            if w < 4 or patterns[s, 0].bit_count() == 3:
                patterns[s, np.argmax(patterns[s] < 0)] = x
    return low, high, patterns


def codeword_indices(segment: np.ndarray) -> np.ndarray:
    """Of 23-bit words, the indices of nearby codewords, 6 columns, -1 where there is none."""
    low, high, patterns = golay_tables()
    near = patterns[low[segment & 4095] ^ high[segment >> 12]]
    return np.where(near >= 0, (segment[:, None] ^ near) >> 11, -1)  # any 12 bits in a row tell codewords apart


def golay_keys(fps: np.ndarray) -> list[np.ndarray]:
    """The join keys of each fingerprint: segment i, a nearby codeword of the next segment, and i."""
    value = fps.astype(np.int64).view(np.uint64)
    parts = [((value >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    keys = []
    for i, part in enumerate(parts):
        near = codeword_indices(parts[(i + 1) % 3])
        keys.append(np.where(near >= 0, (part[:, None] << 14) | (near << 2) | i, -1))
    both = np.concatenate(keys, axis=1)
    return [row[row >= 0] for row in both]


@F.pandas_udf(LONGS)
def keys_of(fps: pd.Series) -> pd.Series:
    return pd.Series(golay_keys(fps.to_numpy()))


@F.pandas_udf(LONGS)
def neighbours(fps: pd.Series) -> pd.Series:
    """Each fingerprint and all at one bit from it."""
    flips = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])
    return pd.Series(list((fps.to_numpy().view(np.uint64)[:, None] ^ flips).view(np.int64)))


def links(nodes: DataFrame, few: int = 16, bits: int = 2) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that join all within 2 bits of each other into one component."""
    keyed = nodes.select("fp", F.explode(keys_of("fp")).alias("key"))
    sizes = cut(keyed.groupBy("key").count().where("count > 1"))
    met = keyed.join(sizes, "key")
    group = met.where(F.col("count") <= few).groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    near = lambda a: lambda b: (b > a) & (F.bit_count(a.bitwiseXOR(b)) <= bits)
    pairs = F.transform("fps", lambda a: F.struct(a.alias("a"), F.filter("fps", near(a)).alias("bs")))
    direct = group.select(F.explode(F.filter(pairs, lambda x: F.size(x["bs"]) > 0)).alias("p")).select("p.a", F.explode("p.bs").alias("b"))
    crowded = met.where(F.col("count") > few).select("fp").distinct()
    spread = crowded.select("fp", F.explode(neighbours("fp")).alias("place"))
    least = cut(spread.groupBy("place").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1"))
    star = spread.join(least, "place").select("a", F.col("fp").alias("b")).where("a != b")
    return direct.union(star).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge and isn't its component's smallest: that smallest node.

    Large-star and small-star steps in turn, each a grouped minimum and a join,
    until all edges go straight to roots; rounds grow with the logarithm of the
    longest chain.
    """
    with Scratch(edges.sparkSession) as keep:
        e = keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
        while not _settled(e):
            both = _both_ways(e, ("u", "v"), ("v", "u"))
            least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
            large = both.join(least, "u").where("v > u")
            large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = _both_ways(large.join(least, "u"), ("v", "m"), ("u", "m"))
            e = keep(small.where("u != v").distinct())
        return cut(e.select(F.col("u").alias("node"), F.col("v").alias("root")))


def _settled(e: DataFrame) -> bool:
    """Whether every node has one edge and no root has an edge to another."""
    ends = F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))
    each = e.select(F.explode(ends).alias("x")).groupBy("x.node").agg(F.sum("x.up").alias("ups"), F.min("x.up").alias("least"))
    return not each.where((F.col("ups") > 1) | ((F.col("ups") > 0) & (F.col("least") == 0))).take(1)


def _both_ways(df: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """Edges (u, v), for every row one of each pair of columns."""
    each = F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs])
    return df.select(F.explode(each).alias("e")).select("e.u", "e.v")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """``docs`` (id and any other columns but the text) with _fp and component_id, the smallest id reachable by links."""
    fps = cut(docs.withColumn("_fp", fingerprints(words)(F.col(text))).drop(text, "component_id"))
    nodes = cut(fps.groupBy(F.col("_fp").alias("fp")).agg(F.min(doc_id).alias("_first")))
    found = components(links(nodes))
    rooted = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "_first", F.coalesce("root", "fp").alias("root"))
    first = rooted.groupBy("root").agg(F.min("_first").alias("component_id"))
    label = cut(rooted.join(first, "root").select(F.col("fp").alias("_of"), "component_id"))
    return fps.join(label, fps["_fp"] == label["_of"]).drop("_of")


MARKS = T.StructType([T.StructField("key", T.StringType()), T.StructField("size", T.IntegerType()), T.StructField("fp", T.LongType()), T.StructField("parity", LONGS), T.StructField("prefix", LONGS)])
#: Bits of the parity bitmap.
PARITY = 512
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Shingles that are set last in the order of prefixes, at most.
COMMON = 500_000


def mix(h: np.ndarray) -> np.ndarray:
    """Another 64-bit hash of each hash."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def distinct_shingles(words: list[bytes], n: int) -> np.ndarray:
    """Sorted hashes of a text's distinct n-word shingles (of the whole sequence, if shorter)."""
    hashes = np.frombuffer(b"".join([xxhash.xxh64_digest(w, SEED) for w in words]), ">u8").astype(np.uint64)
    joined = np.zeros(max(1, len(hashes) - n + 1), np.uint64)
    for i in range(min(n, len(hashes))):
        joined = joined * ODD + hashes[i : i + len(joined)]
    return np.unique(mix(joined).view(np.int64))


def bits_of(shingles: np.ndarray) -> int:
    """The SimHash of distinct shingles' hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(shingles), SLICE):
        ones += np.unpackbits(shingles[at : at + SLICE].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles)).view(">i8")[0])


def parity_of(shingles: np.ndarray) -> np.ndarray:
    """Whether the number of shingles in each of PARITY bins is odd. Bits that differ between two sets are at most the shingles that only one has."""
    return np.packbits(np.bincount(shingles & (PARITY - 1), minlength=PARITY) & 1).view(np.int64)


def common_shingles(rows: DataFrame, n: int) -> np.ndarray:
    """Sorted hashes of n-word shingles that several texts of a batch have, of the most frequent COMMON at most. A shingle of many texts is in several batches and found."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in np.array_split(batch["text"].to_numpy(object), 1 + batch["text"].str.len().sum() // SLICE_CHARS):
                found, times = np.unique(np.concatenate([np.empty(0, np.int64), *(distinct_shingles(words_of(t), n) for t in part)]), return_counts=True)
                yield pd.DataFrame({"s": found[times > 1], "n": times[times > 1]})

    counts = rows.select("text").mapInPandas(count, "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
    counts = cut(counts.withColumn("_bin", F.floor(8 * F.log2("n"))))
    total, least = 0, None
    for r in counts.groupBy("_bin").count().orderBy(F.desc("_bin")).collect():  # eight for each doubling, some hundreds
        total += r["count"]
        if total > COMMON:
            break
        least = r["_bin"]
    top = counts.where(F.col("_bin") >= F.lit(least).cast("long")).select("s").toPandas()  # COMMON rows of 8 bytes at most
    return np.sort(top["s"].to_numpy(np.int64))


def prefix_marks(n: int, similarity: float, common=None):
    """A column function: a text's words as one hash, its number of distinct shingles, their SimHash, parities and prefix.

    The prefix is the first size - ceil(similarity * size) + 1 shingles in one order of
    all shingles: those of ``common`` (a broadcast sorted array) last, else by hash.
    Two sets alike to ``similarity`` have a shingle of both prefixes in common,
    whatever the order.
    """

    @F.pandas_udf(MARKS)
    def of(texts: pd.Series) -> pd.DataFrame:
        rows, last = [], np.empty(0, np.int64) if common is None else common.value
        for text in texts:
            words = words_of(text)
            shingles = distinct_shingles(words, n)
            size, marks = len(shingles), (bits_of(shingles), parity_of(shingles))
            if len(last):
                late = last[np.minimum(np.searchsorted(last, shingles), len(last) - 1)] == shingles
                shingles = np.concatenate([shingles[~late], shingles[late]])
            take = size - math.ceil(similarity * size - 1e-9) + 1
            rows.append((xxhash.xxh3_128_hexdigest(b" ".join(words)), size, *marks, shingles[:take]))
        return pd.DataFrame(rows, columns=MARKS.names)

    return of


def shingle_set(text, n: int):
    """Column: hashes of a text's distinct n-word shingles (of the whole sequence, if shorter)."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))
    each = lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(w) - n)), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(n)]))
    return let(words, lambda w: F.array_distinct(each(w)))


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, similarity: float, keep) -> DataFrame:
    """The pairs (a, b) of nodes (id, row, size, parity) whose shingle sets are alike to ``similarity``; ``row`` names the row of ``texts`` (row, text) that a node stands for.

    Sizes and parities rule out only pairs that can't be: alike sets of x and y
    shingles have at most (1 - s) / (1 + s) (x + y) that aren't in both.
    """
    side = lambda s: nodes.select(F.col("id").alias(s), F.col("size").alias(f"{s}_size"), F.col("parity").alias(f"{s}_parity"))
    possible = (F.least("a_size", "b_size") >= similarity * F.greatest("a_size", "b_size") - 1e-9) & (differing("a_parity", "b_parity") <= not_in_both(F.col("a_size"), F.col("b_size"), similarity))
    found = keep(pairs.distinct().join(side("a"), "a").join(side("b"), "b").where(possible).select("a", "b"))
    wanted = found.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(nodes.select("id", "row"), "id")
    sets = texts.join(wanted, "row").select("id", shingle_set(F.col("text"), words).alias("set"))
    sets = keep(sets.groupBy("id").agg(F.first("set").alias("set")))  # rows of one id and text are equal
    side = lambda s: sets.select(F.col("id").alias(s), F.col("set").alias(f"{s}_set"))
    both = found.join(side("a"), "a").join(side("b"), "b")
    share = F.size(F.array_intersect("a_set", "b_set")) / F.size(F.array_union("a_set", "b_set"))
    return keep(both.where(share >= similarity).select("a", "b"))


def golay_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes (id, fp) with equal fingerprints or ones that links() joins: of each fingerprint the smallest id."""
    first = cut(nodes.groupBy("fp").agg(F.min("id").alias("first")))
    same = nodes.join(first, "fp").where("id != first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    side = lambda s: first.select(F.col("fp").alias(s), F.col("first").alias(f"{s}_first"))
    near = links(first.select("fp")).join(side("a"), "a").join(side("b"), "b")
    return same.union(near.select(*ordered_pair("a_first", "b_first")))


def ordered_pair(x, y) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def joined(found: DataFrame, more: DataFrame) -> DataFrame:
    """(node, root) of the components ``found`` and further edges (a, b): only edges between roots take rounds."""
    up = lambda s: found.select(F.col("node").alias(s), F.col("root").alias(f"{s}_root"))
    roots = more.join(up("a"), "a", "left").join(up("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    new = components(roots.where("a != b").distinct())
    top = new.select(F.col("node").alias("root"), F.col("root").alias("_top"))
    moved = found.join(top, "root", "left").select("node", F.coalesce("_top", "root").alias("root"))
    return cut(moved.union(new))


def overlap(x, y, similarity: float):
    """Shingles that sets of x and y have in common at least, if they are alike to ``similarity``."""
    return F.ceil(similarity / (1 + similarity) * (x + y) - 1e-9)


def differing(a: str, b: str):
    """Bits that two parity columns differ in."""
    return sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(PARITY // 64)), F.lit(0))


def not_in_both(x, y, similarity: float):
    """Shingles that are in only one of two sets of x and y at most, if they are alike to ``similarity``."""
    return (1 - similarity) / (1 + similarity) * (x + y) + 1e-9


def can_be(x, x_pos, y, y_pos, similarity: float):
    """Whether sets of x and y may be alike whose first common shingle is at these positions, so far as sizes and what follows tell."""
    least = overlap(x, y, similarity)
    return (F.least(x, y) >= similarity * F.greatest(x, y) - 1e-9) & (x_pos <= x - least) & (y_pos <= y - least)


def similar_components(nodes: DataFrame, texts: DataFrame, words: int, similarity: float, few: int) -> DataFrame:
    """(node, root) of components() over all pairs of nodes (id, size, fp, parity, prefix) alike to ``similarity``.

    First the pairs whose SimHash fingerprints meet in Golay keys are verified and
    joined. What is alike with more bits apart is found in buckets, a bucket being
    a shingle of prefixes: in one of at most ``few`` nodes all pairs that aren't in one
    component yet are verified. In a larger one leaders are, with every other node of
    the bucket that isn't in their component yet; then they leave the bucket, and
    all others stay. A round takes four times as many leaders as the one before, those
    first that share most, and a bucket is done when all its nodes are in one
    component or all outside its largest component have led. So no pair in a bucket
    goes untested unless both nodes are linked already, or the sizes and the positions of
    the shingle leave too few for their sets to be alike; the bucket of the first shingle
    that two alike sets have in common never does.
    """
    with Scratch(nodes.sparkSession) as keep:
        found = components(verified(golay_pairs(nodes), nodes, texts, words, similarity, keep))
        keyed = nodes.select("id", "size", F.posexplode("prefix").alias("pos", "bucket"))
        counts = keyed.groupBy("bucket").agg(F.count("*").alias("_n"), F.min("size").alias("_least")).where("_n > 1")
        alone = F.col("pos") <= F.col("size") - overlap(F.col("size"), F.greatest(F.col("_least"), similarity * F.col("size")), similarity)
        met = keep(keyed.join(counts, "bucket").where(alone).drop("_n", "_least"))
        members = [F.bit_xor(F.xxhash64(F.lit(k), "id")).alias(f"_m{k}") for k in (1, 2)]
        once = met.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("pos").alias("_at"), *members).where("n > 1")
        once = once.groupBy("n", "_m1", "_m2").agg(F.min_by("bucket", F.struct("_at", "bucket")).alias("bucket")).select("bucket", "n")
        met = keep(met.join(once, "bucket"))  # of buckets with the same nodes the first in the order: positions in it are least
        root = lambda rows: rows.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        group = root(met.where(F.col("n") <= few)).groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("id", "root", "size", "pos"))).alias("ids")).select("ids")
        apart = lambda a: lambda b: (b["id"] > a["id"]) & (b["root"] != a["root"]) & can_be(a["size"], a["pos"], b["size"], b["pos"], similarity)
        pairs = F.flatten(F.transform("ids", lambda a: F.transform(F.filter("ids", apart(a)), lambda b: F.struct(a["id"].alias("a"), b["id"].alias("b")))))
        more = verified(group.select(F.explode(pairs).alias("p")).select("p.a", "p.b"), nodes, texts, words, similarity, keep)
        found = joined(found, more)
        met = met.where(F.col("n") > few)
        popular = met.groupBy("id").agg(F.sum("n").alias("_shared"))
        left = keep(met.select("bucket", "id", "size", "pos").join(popular, "id").join(nodes.select("id", "parity"), "id"))
        leaders, member = 1, ("id", "root", "size", "pos", "parity")
        while left.take(1):
            labelled = keep(root(left))
            parts = labelled.groupBy("bucket", "root").agg(F.count("*").alias("_n"))
            parts = parts.groupBy("bucket").agg(F.max_by("root", F.struct("_n", "root")).alias("_largest"), (F.sum("_n") - F.max("_n")).alias("_outside")).where("_outside > 0")
            labelled = keep(labelled.join(parts, "bucket"))
            ends = F.col("_outside") <= few * leaders
            lot = F.pmod(F.xxhash64(F.lit(leaders), "id"), F.lit(leaders))
            who = [F.col(f"x.{c}").alias(f"_{c}") for c in member]
            first = labelled.where(~ends).groupBy("bucket", lot.alias("_lot")).agg(F.max(F.struct("_shared", *member)).alias("x")).select("bucket", *who)
            last = labelled.where(ends & (F.col("root") != F.col("_largest"))).select("bucket", *[F.col(c).alias(f"_{c}") for c in member])
            lead = keep(first.union(last))
            tested = (labelled["root"] != lead["_root"]) & (labelled["bucket"] == lead["bucket"]) & can_be(labelled["size"], labelled["pos"], lead["_size"], lead["_pos"], similarity)
            tested = tested & (differing("parity", "_parity") <= not_in_both(labelled["size"], lead["_size"], similarity))
            pairs = labelled.join(lead, tested).select(*ordered_pair("_id", "id"))
            found = joined(found, verified(pairs, nodes, texts, words, similarity, keep))
            done = lead.select("bucket", F.col("_id").alias("id"))
            left = keep(labelled.where(~ends).select("bucket", "id", "size", "pos", "_shared", "parity").join(done, ["bucket", "id"], "left_anti"))
            leaders *= 4
        return found  # a checkpoint of its own


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, few: int = 16) -> DataFrame:
    """The rows of ``docs`` that stay: of texts linked by equal words or by shingle sets alike to ``similarity``, the smallest id.

    Candidates have SimHash fingerprints that meet in Golay keys, or share a shingle of
    their prefixes (see prefix_marks): all pairs alike to ``similarity`` are among
    them. Common shingles go last in prefixes: this orders the work and leaves the
    result as it is. Rows without an id stay; null and blank texts are equal; rows that share an id
    and have different texts are different documents, of which a hash of the text tells the smaller;
    rows equal in id and text all stay or none.
    """
    row = F.struct(F.col(doc_id).alias("id"), *[h.alias(f"t{i}") for i, h in enumerate(row_hashes(text))])
    rows = docs.where(F.col(doc_id).isNotNull()).select(row.alias("row"), F.col(text).alias("text"))
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(rows, words))  # COMMON at most
    marks = rows.select("row", prefix_marks(words, similarity, common)("text").alias("w")).select("row", "w.*")
    nodes = marks.groupBy("key").agg(F.min("row").alias("row"), *[F.first(c).alias(c) for c in ("size", "fp", "parity", "prefix")]).drop("key")
    nodes = cut(nodes.withColumn("id", F.monotonically_increasing_id()))
    found = similar_components(nodes, rows, words, similarity, few).withColumnRenamed("node", "id")
    kept = nodes.select("id", "row").join(found, "id", "left").groupBy(F.coalesce("root", "id")).agg(F.min("row").alias("_stay")).select("_stay")
    out = docs.withColumn("_row", row)
    return out.join(kept, out["_row"] == kept["_stay"], "left").where(F.col("_stay").isNotNull() | F.col(doc_id).isNull()).drop("_row", "_stay")


def query(spark, sf_dir: str) -> DataFrame:
    """op1: every document's fingerprint and component."""
    out = near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")

"""Operator 10: document fingerprints by Order MinHash. DataFrame functions only.

A text's k-mers are runs of ``k`` units, a unit being a word or 16 characters of
a longer one. Equal k-mers are numbered by occurrence, and each (k-mer, number)
is hashed once; the top bits of the hash choose one of ``bins`` samples, and in
each the ``length`` smallest are selected, put back in text order and hashed as a
tuple. So a bin agrees if both texts hold its smallest k-mers in the same order,
which moving text about breaks as well as changing it: the share of bins that
agree falls with edit distance. One hash with bins stands for many orders of all
k-mers, at one sort a text. Only docs' ids are ranked over all rows; the text of
the following document comes by a join on the id.

Defined results: null and empty texts have an empty fingerprint, alike (1) with
another empty one and unlike (0) anything else; a null id comes last; rows that
share an id follow the same document, and stand as its smallest text for the one
before; one row alone follows itself; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presentia.llm.common import cut, let, ranked, read_table

UNIT = r"[^\x20\x09-\x0D]{1,16}"
#: Bits of a packed long that hold the position, of texts of more units a part of it; the others hold a hash.
AT = 24
MASK = (1 << AT) - 1


def sketch(text: Column, k: int = 3, bins: int = 64, length: int = 2) -> Column:
    """The fingerprint of a text: for each bin that isn't empty, bin << 32 | 32 bits of its tuple's hash, in order of bins."""
    units = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(UNIT), F.lit(0))
    none = F.array().cast("array<long>")
    high = lambda x: F.shiftright(x, AT)
    pack = lambda h, at: F.shiftleft(h, AT).bitwiseOR(at)
    at_of = lambda x: x.bitwiseAND(F.lit(MASK))
    last = lambda u: F.greatest(F.lit(0), F.size(u) - k)
    place = lambda u, i: F.when(F.size(u) <= MASK, i.cast("long")).otherwise(F.floor(i * (MASK / F.size(u))).cast("long"))
    kmers = lambda u: F.sort_array(F.transform(F.sequence(F.lit(0), last(u)), lambda i: pack(F.xxhash64(*[F.get(u, i + j) for j in range(k)]), place(u, i))))
    run_starts = lambda a: F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda j: (j == 0) | (high(F.get(a, j)) != high(F.get(a, j - 1))))
    numbered = lambda x, n: pack(F.xxhash64(high(x), n), at_of(x))

    def runs(a: Column) -> Column:
        def of(s: Column) -> Column:
            one = lambda b, r: F.transform(F.sequence(b, F.coalesce(F.get(s, r + 1), F.size(a)) - 1), lambda j: numbered(F.get(a, j), j - b))
            return F.when(F.size(s) == F.size(a), F.transform(a, lambda x: numbered(x, F.lit(0)))).otherwise(F.flatten(F.transform(s, one)))

        return let(run_starts(a), of)

    bin_of = lambda x: F.shiftrightunsigned(x, 64 - bins.bit_length() + 1)
    smallest = lambda e: F.filter(e, lambda x, i: (i < length) | (bin_of(F.get(e, i - length)) != bin_of(x)))

    def tuples(e: Column) -> Column:
        firsts = F.filter(F.sequence(F.lit(0), F.size(e) - 1), lambda i: (i == 0) | (bin_of(F.get(e, i)) != bin_of(F.get(e, i - 1))))
        text_order = lambda x: F.shiftleft(at_of(x), 64 - AT).bitwiseOR(F.shiftrightunsigned(x, AT))
        same = lambda i: F.filter(F.slice(e, i + 1, F.lit(length)), lambda y: bin_of(y) == bin_of(F.get(e, i)))
        words = lambda i: F.transform(F.sort_array(F.transform(same(i), text_order)), lambda v: v.bitwiseAND(F.lit((1 << 64 - AT) - 1)))
        code = lambda i: F.xxhash64(words(i)).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.transform(firsts, lambda i: F.shiftleft(bin_of(F.get(e, i)), 32).bitwiseOR(code(i)))

    whole = lambda u: let(let(let(kmers(u), lambda a: F.sort_array(runs(a))), smallest), tuples)
    return let(units, lambda u: F.when(F.size(u) == 0, none).otherwise(whole(u)))


def likeness(a: Column, b: Column) -> Column:
    """Share of bins, of those not empty in both, that agree."""
    bins = lambda s: F.transform(s, lambda x: F.shiftright(x, 32))
    either = F.size(F.array_union(bins(a), bins(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def as_string(s: Column) -> Column:
    """A fingerprint as text: ten hex digits a bin."""
    return F.array_join(F.transform(s, lambda x: F.lower(F.lpad(F.hex(x), 10, "0"))), "")


def followers(ids: DataFrame) -> DataFrame:
    """(_id, _next, _before, _third) for each id of (_id, _n): the next smaller id and the next larger, cyclically, and a third of its own length."""
    by = cut(ranked(ids.groupBy("_id").agg(F.max("_n").alias("_n")), [F.col("_id").desc_nulls_last()], "_at"))
    total = max(1, by.count())
    here = F.struct("_id", "_n")
    empty = F.lit(None).cast("struct<_id:bigint,_n:int>")
    role = lambda shift, at: F.struct(F.pmod(F.col("_at") + shift, F.lit(total)).alias("slot"), *[(here if i == at else empty).alias(c) for i, c in enumerate(("own", "next", "before"))])
    met = by.select(F.explode(F.array(role(0, 0), role(-1, 1), role(1, 2))).alias("r"))
    met = met.groupBy("r.slot").agg(*[F.max(f"r.{c}").alias(c) for c in ("own", "next", "before")])
    return met.select("own._id", F.col("next._id").alias("_next"), F.col("before._id").alias("_before"), F.floor(F.col("own._n") / 3).cast("int").alias("_third"))


def with_next_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, _text, _before, _head): each document beside the id of the one before and the beginning of the next one's text."""
    docs = docs.select(F.col(doc_id).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    after = cut(followers(docs.select("_id", F.length("_text").alias("_n"))))
    ahead = after.select(F.col("_id").alias("_for"), F.col("_next").alias("_of"), "_third")
    heads = docs.join(ahead, docs["_id"].eqNullSafe(ahead["_of"])).select("_for", F.substring(F.col("_text"), F.lit(1), F.col("_third")).alias("_head"))
    heads = heads.groupBy("_for").agg(F.min("_head").alias("_head"))
    after = after.select(F.col("_id").alias("_own"), "_before")
    near = heads.join(after, heads["_for"].eqNullSafe(after["_own"])).select("_for", "_head", "_before")
    return docs.join(near, docs["_id"].eqNullSafe(near["_for"])).select("_id", "_text", "_before", "_head")


def query(spark, sf_dir: str) -> DataFrame:
    """op10: fingerprints of every document and of its edited text, and their likenesses."""
    rows = with_next_text(read_table(spark, sf_dir, "documents"))
    n = F.length("_text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("_text"), F.lit(1), n - third), F.substring(F.col("_head"), F.lit(1), third))
    rows = rows.select("_id", "_before", n.cast("long").alias("n_chars"), "_text", edited.alias("_edited"))
    rows = rows.select("_id", "_before", "n_chars", F.sha2("_edited", 256).alias("sha"), sketch(F.col("_text")).alias("own"), sketch(F.col("_edited")).alias("changed"))
    # a record that stays at the document, and one that takes its fingerprint to the document before
    none = F.lit(None).cast("array<long>")
    stays = F.struct(F.col("_id").alias("at"), "n_chars", "sha", "own", "changed", none.alias("next"))
    goes = F.struct(F.col("_before").alias("at"), F.lit(None).cast("long").alias("n_chars"), F.lit(None).cast("string").alias("sha"), none.alias("own"), none.alias("changed"), F.col("own").alias("next"))
    sent = rows.select(F.explode(F.array(stays, goes)).alias("r")).select("r.*")
    met = sent.withColumn("theirs", F.min("next").over(Window.partitionBy("at"))).where(F.col("own").isNotNull())
    return met.select(
        F.col("at").alias("doc_id"), "n_chars", F.col("sha").alias("edited_sha256"), as_string(F.col("own")).alias("fingerprint"), as_string(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("theirs")).alias("near_next"),
    )

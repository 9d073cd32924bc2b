"""Operator 3: mixing sources to target weights by entropy balancing. DataFrame functions only.

Every source has a target number of tokens. Among all rates r of the documents
that meet the targets, the ones nearest to 1 are wanted, with r between 0 and
``most``: the bounded-entropy distance, whose convex dual has one multiplier for
each source and whose solution tilts each document exponentially,
r = most / (1 + (most - 1) exp(-lambda x)), where x grows from 0.5 to 1.5 with the document's
size against its source's mean. Newton steps on all duals at once run as
aggregations over (source, size) counts. The rates become whole copies by error
diffusion within cells of about ``cell`` documents of one source, long documents
first, so that what rounding leaves over is less than a short document.

Defined results: a null text has size 0, takes nothing and is kept once; a null
source is a source of its own, last in order; with no words at all the targets are 0; an empty table gives
an empty result. Rows equal in id, source and size share a decision: so many copies for
all of them, one more for some if that doesn't divide. Everything comes from hashes of
ids and sizes, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presentia.llm.common import cut, ranked, read_table, row_hashes

SPACE = " \t\n\x0b\x0c\r"
#: Newton steps in a job, and jobs at most: a bracket of 400 is halved to nothing by then.
STEPS, JOBS = 8, 12


def size_of(text: Column) -> Column:
    """Number of words of a text."""
    body = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(body == "", 0).otherwise(F.size(F.split(body, r"[\x20\x09-\x0D]+"))).cast("long")


def source_targets(sizes: DataFrame, source: str, weights=(3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """A row for each source: _rank, its size, number of documents and target.

    The targets share ``share`` of all sizes by weight, none above ``most`` times its source's size.
    """
    by = sizes.groupBy(source).agg(F.sum("size").alias("source_size"), F.count("*").alias("_docs"))
    by = ranked(by, [F.col(source).asc_nulls_last()], "_rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    by = cut(by.withColumns({"_weight": weight, "_cap": most * F.col("source_size").cast("double")}))
    level, before = 0.0, -1.0
    total = share * (by.agg(F.sum("source_size")).first()[0] or 0)
    while level != before:  # a weight's share; it only rises, as each step caps more sources
        over = F.col("_cap") < level * F.col("_weight")
        capped, free = by.agg(F.sum(F.when(over, F.col("_cap")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("_weight")))).first()
        level, before = ((total - capped) / free if free else level), level
    return by.withColumn("target", F.least("_cap", level * F.col("_weight"))).drop("_weight", "_cap")


def rate(multiplier: Column, size: Column, mean: Column, most: int) -> Column:
    """A document's rate; 1 where the multiplier is 0."""
    return most / (1 + (most - 1) * F.exp(-multiplier * leverage(size, mean)))


def leverage(size: Column, mean: Column) -> Column:
    """From 0.5 for the shortest to 1.5 for the longest documents of a source."""
    return 0.5 + size / (size + mean)


def multipliers(counts: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """The dual's solution: _rank and _lambda, by Newton steps kept inside a shrinking bracket."""
    ratio = F.col("target") / F.col("source_size")
    start = F.when(ratio >= most, F.lit(60.0)).otherwise(F.log((most - 1) * ratio / (most - ratio)))
    state = targets.where("source_size > 0").select(
        "_rank", "target", (F.col("source_size") / F.col("_docs")).alias("_mean"),
        start.alias("_lambda"), F.lit(-200.0).alias("_low"), F.lit(200.0).alias("_high"),
    )
    size = F.col("size").cast("double")
    for _ in range(JOBS):
        for _ in range(STEPS):
            r, x = rate(F.col("_lambda"), size, F.col("_mean"), most), leverage(size, F.col("_mean"))
            keep = [F.first(c).alias(c) for c in ("target", "_mean", "_lambda", "_low", "_high")]
            sums = counts.join(state, "_rank").groupBy("_rank").agg(*keep, F.sum(F.col("_n") * size * r).alias("_got"), F.sum(F.col("_n") * size * x * r * (1 - r / most)).alias("_slope"))
            much, near = F.col("_got") > F.col("target"), F.abs(F.col("_got") - F.col("target")) < 1e-9 * F.col("target")
            low, high = F.when(much, F.col("_low")).otherwise(F.col("_lambda")), F.when(much, F.col("_lambda")).otherwise(F.col("_high"))
            step = F.col("_lambda") - (F.col("_got") - F.col("target")) / F.col("_slope")
            new = F.when(near, F.col("_lambda")).when((F.col("_slope") > 0) & (step > low) & (step < high), step).otherwise((low + high) / 2)
            state = sums.select("_rank", "target", "_mean", new.alias("_lambda"), low.alias("_low"), high.alias("_high"), near.alias("_near"))
        state = cut(state)
        if not state.where(~F.col("_near") & (F.col("_high") - F.col("_low") > 1e-9)).take(1):
            break
        state = state.drop("_near")
    return state.select("_rank", "_lambda")


def decisions(docs: DataFrame, doc_id: str, text: str, source: str, weights=(3, 1, 2), share: float = 1.5, most: int = 2, cell: int = 256) -> DataFrame:
    """A row for all documents that are equal in id, source and text: _id, _source, size, a hash of all three (_k0, _k1), how many they are (same), source_size, target, rate, and the copies of all of them."""
    keys = ["_k0", "_k1"]
    key = [k.alias(name) for k, name in zip(row_hashes(doc_id, source, text), keys, strict=True)]
    sizes = cut(docs.select(F.col(doc_id).alias("_id"), F.col(source).alias("_source"), size_of(F.col(text)).alias("size"), *key))
    targets = cut(source_targets(sizes, "_source", weights, share, most))
    sizes = sizes.join(targets.withColumnRenamed("_source", "_of"), F.col("_source").eqNullSafe(F.col("_of"))).drop("_of")
    counts = cut(sizes.where("size > 0").groupBy("_rank", "size").agg(F.count("*").alias("_n")))
    solved = cut(multipliers(counts, targets, most))
    mean = F.col("source_size") / F.col("_docs")
    rates = sizes.join(solved, "_rank", "left").withColumn("rate", F.when(F.col("size") > 0, rate(F.col("_lambda"), F.col("size").cast("double"), mean, most)).otherwise(F.lit(1.0)))
    # rows that are equal in all that matters here are one row with their number
    rates = rates.groupBy("_rank", "_id", "size", "rate", *keys).agg(F.count("*").alias("same"), *[F.first(c).alias(c) for c in ("_source", "source_size", "target", "_docs")])
    salt = F.pmod(F.xxhash64(F.lit(11), *keys), F.ceil(F.col("_docs") / cell))
    row = F.struct((-F.col("size")).alias("short"), F.xxhash64(F.lit(12), "_id").alias("tie"), F.col("_id").alias("id"), *keys, "rate", "same")
    rates = rates.withColumn("_salt", salt).repartition("_rank", "_salt")  # else a large source's cells would share a task
    cells = rates.groupBy("_rank", "_salt").agg(
        *[F.first(c).alias(c) for c in ("_source", "source_size", "target")], F.sort_array(F.collect_list(row)).alias("rows")
    )  # about `cell` rows each
    size = lambda x: -x["short"].cast("double")
    start = F.struct(F.lit(0.0).alias("over"), F.array().cast("array<long>").alias("copies"))

    def round_one(s: Column, x: Column) -> Column:
        wanted = x["rate"] * x["same"] + s["over"] / size(x)
        copies = F.when(x["short"] == 0, x["same"]).otherwise(F.least(most * x["same"], F.greatest(F.lit(0), F.round(wanted)))).cast("long")
        return F.struct((s["over"] + (x["rate"] * x["same"] - copies) * size(x)).alias("over"), F.concat(s["copies"], F.array(copies)).alias("copies"))

    copies = F.aggregate("rows", start, round_one, lambda s: s["copies"])
    each = cells.withColumn("each", F.explode(F.arrays_zip(F.col("rows").alias("row"), copies.alias("all"))))
    row = F.col("each.row")
    return each.select(row["id"].alias("_id"), "_source", (-row["short"]).alias("size"), *[row[k].alias(k) for k in keys], row["same"].alias("same"), row["rate"].alias("rate"), "source_size", "target", F.col("each.all").alias("all"))


def numbered(rows: DataFrame, n: Column, lot: int = 1000) -> DataFrame:
    """Every row ``n`` times, with _nth from 0; large numbers are dealt out in lots first."""
    upto = lambda a, b: F.explode(F.sequence(a, b)).alias("_nth")
    few = rows.where((n > 0) & (n <= lot)).select("*", upto(F.lit(0).cast("long"), n - 1))
    lots = rows.where(n > lot).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / lot))).alias("_lot"))
    many = lots.repartition("_k0", "_lot")
    return few.unionByName(many.select("*", upto(F.col("_lot") * lot, F.least(F.col("_lot") * lot + lot, n) - 1)).drop("_lot"))


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """A row for each document: its id, source, size, source_size, target, rate, copies and taken; ``how`` as in decisions()."""
    each = numbered(cut(decisions(docs, doc_id, text, source, **how)), F.col("same"))
    own = F.floor(F.col("all") / F.col("same")) + (F.col("_nth") < F.col("all") % F.col("same")).cast("long")
    return each.select(F.col("_id").alias(doc_id), "size", "source_size", "target", (F.col("size") * own).alias("taken"), F.col("_source").alias(source), "rate", own.alias("copies"))


def repeat_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """``docs`` with every row as often as the mix takes it; of rows equal in id, source and text any may have the copy that doesn't divide."""
    key = row_hashes(doc_id, source, text)
    mix = cut(decisions(docs, doc_id, text, source, **how).select("_k0", "_k1", F.floor(F.col("all") / F.col("same")).alias("_copies"), (F.col("all") % F.col("same")).alias("_rest")))
    keyed = docs.withColumns({"_r0": key[0], "_r1": key[1]})
    same = lambda m: (keyed["_r0"] == m["_k0"]) & (keyed["_r1"] == m["_k1"])
    taken = keyed.join(mix.where("_copies > 0"), same(mix)).drop("_rest")
    more = mix.where("_rest > 0")
    extra = keyed.join(more, same(more)).drop("_copies").dropDuplicates(["_k0", "_k1"]).withColumnRenamed("_rest", "_copies")  # equal rows but one go
    lots = lambda df: numbered(df, F.col("_copies")).select(*docs.columns)
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*docs.columns).unionByName(lots(extra))


def query(spark, sf_dir: str) -> DataFrame:
    """op3: what the mix takes of every document."""
    return mix_sources(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")

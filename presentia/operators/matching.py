"""The containment join: which distinct marker sequences occur in which genomes.

Every strategy returns the same rows (genome_id, seq); planner.choose picks one.
Genomes are cut into overlapping chunks first, so that one long genome is spread
over many tasks and no array holds a window for each of its bases.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presentia.functions import dna
from presentia.operators import scanning, seeding

STRIDE = 1 << 16
#: Markers below this length give useless seeds.
SHORT = 10
#: Longest seed; more bases don't make it rarer.
SEED = seeding.LONGEST
#: At most so many bases of a window are kept for the first comparison; longer markers are verified on the chunk.
WINDOW = 64
#: Most markers, and most of their bases, that are broadcast to all tasks.
BROADCAST_MARKERS, BROADCAST_BASES = 500, 1 << 22


def distinct_markers(markers: DataFrame) -> DataFrame:
    """(seq, length) of the valid sequences, each once."""
    return markers.where(dna.is_valid_marker(F.col("seq"))).select("seq").distinct().withColumn("length", F.length("seq"))


def chunks(genomes: DataFrame, longest: int, stride: int = STRIDE, spread: bool = False) -> DataFrame:
    """(genome_id, chunk_no, chunk): every start lies in one stride, and a match from there of up to ``longest`` bases in its chunk.

    A genome that fits in one chunk isn't cut. ``spread`` deals chunks out over the cluster.
    """
    reach = stride + max(1, longest) - 1
    pattern = f"(?=([ACGTN]{{1,{reach}}}))[ACGTN]{{1,{stride}}}"
    cut = F.when(F.length("seq") <= stride, F.array("seq")).otherwise(F.regexp_extract_all("seq", F.lit(pattern), F.lit(1)))
    out = genomes.select("genome_id", F.posexplode(cut).alias("chunk_no", "chunk")).where("chunk != ''")  # a filter on seq would go below the dealing out of rows, and clean all texts in the tasks that read
    return out.repartition("genome_id", "chunk_no") if spread else out


def nested(genomes: DataFrame, markers: DataFrame) -> DataFrame:
    """Every chunk against every marker; for a marker table whose size was checked to be small."""
    every = sorted(r.seq for r in markers.select("seq").toLocalIterator())  # as many as the planner lets through
    table = markers.sparkSession.createDataFrame(list(enumerate(every)), "_id int, seq string")
    hits = scanning.found(genomes, every)
    return hits.select("genome_id", F.explode(scanning.ones(F.col("words"), len(every))).alias("_id")).join(F.broadcast(table), "_id").select("genome_id", "seq")


def seeded(pieces: DataFrame, markers: DataFrame, seed: int, longest: int, broadcast: bool, sampled: bool = False) -> DataFrame:
    """Join of the starts that seeding lets through with the markers' seeds, then comparison of what follows.

    ``seed`` bases are in every marker. Windows stop at breaks by themselves. With
    ``broadcast`` off the join is shuffled by seed, and Spark splits seeds that are very
    frequent. ``sampled`` tests minimizers only.
    """
    seed, width = min(seed, SEED), min(longest, WINDOW)
    k, w = (-(-2 * seed // 3), seed // 3 + 1) if sampled else (seed, 1)
    wanted = seeding.marker_seeds(markers.select("seq", "length"), k, w).withColumn("head", F.left("seq", F.lit(width)))
    starts = seeding.starts(pieces, seeding.table_of(wanted.select("seed").distinct()), k, w, width)
    wanted = F.broadcast(wanted) if broadcast else wanted
    begins = F.expr("shift <= before AND substring(around, before - shift + 1, length(head)) = head")
    hits = starts.join(wanted, "seed").where(begins).select("genome_id", "chunk_no", "seq", "length")
    sure = hits.where(F.col("length") <= width).select("genome_id", "seq")
    if longest <= width:
        return sure.distinct()
    maybe = hits.where(F.col("length") > width).distinct()
    long = maybe.join(pieces, ["genome_id", "chunk_no"]).where(F.expr("contains(chunk, seq)")).select("genome_id", "seq")
    return sure.union(long).distinct()


def by_length(pieces: DataFrame, markers: DataFrame, lengths: list[int]) -> DataFrame:
    """An equi-join on whole k-grams, of which only those of some marker become rows; for many short markers (at most 4 ** length of them)."""
    wanted = markers.select("seq", scanning.gram_of(F.col("seq")).alias("gram"))
    return scanning.grams(pieces, wanted, lengths).join(wanted, "gram").select("genome_id", "seq")


def match(genomes: DataFrame, markers: DataFrame, strategy: str = "auto", stride: int = STRIDE, spread: bool = False) -> DataFrame:
    """(genome_id, seq): each distinct marker sequence that a genome (genome_id, seq) contains.

    ``markers`` needs only seq; strategies are auto, nested, seeded, sampled, shuffled, by_length.
    Genomes are matched in the tasks that read them; ``spread`` deals their chunks out, for
    few genomes that are long. Files of such genomes are better read as pieces, for match_pieces().
    """
    return match_pieces(lambda longest: chunks(genomes.select("genome_id", "seq"), longest, stride if stride != STRIDE else max(stride, longest), spread), markers, strategy)


def match_pieces(pieces, markers: DataFrame, strategy: str = "auto") -> DataFrame:
    """(genome_id, seq) as match() has it; ``pieces`` gives (genome_id, chunk_no, chunk) that overlap enough for markers of a given length."""
    from presentia.plans import planner

    wanted = distinct_markers(markers)
    plan = planner.choose(planner.statistics(wanted), strategy)
    cut = pieces(max(1, plan.longest))
    if plan.empty:
        return cut.select("genome_id", F.col("chunk").alias("seq")).where("false")
    parts = []
    for step in plan.steps:
        part = wanted.where(F.col("length").between(step.least, step.most))
        if step.kind == "nested":
            parts.append(nested(cut, part))
        elif step.kind == "by_length":
            parts.append(by_length(cut, part, step.lengths))
        else:
            parts.append(seeded(cut, part, step.least, step.most, step.kind == "seeded", strategy == "sampled"))
    return reduce(DataFrame.union, parts)

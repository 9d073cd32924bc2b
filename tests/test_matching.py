"""Which markers a genome contains: fixed vectors, edge cases, and all strategies against Python's `in`."""

import random

import pytest
from pyspark.sql import functions as F

from presentia import api
from presentia.operators import matching, matrix
from presentia.plans import planner
from presentia.sources import readers

# Genome, markers, expected bits.
VECTORS = """
A | A | 1
A | C | 0
AC | A | 1
AA | A | 1
AA | C | 0
AC | C | 1
ACAAA | G | 0
ACCCA | A C G | 110
ACTTTTTTCG | A C G | 111
GCTTTTTTCG | T G C A | 1110
ACNNNA | ACA AC | 01
NNNNNN | ACA AC | 00
NNNNNAGTNNNNA | AT AGTA TA | 000
ACGTA | ACG CGTA | 11
ACGTA | AC CG GTA | 111
ACTGA | CTG T | 11
ACGTGTCACGT | ACGTG CACGT GTG TCA T TT | 111110
ACGTGTCACGT | TCACC CGTA CACGT CAC ACGT | 00111
ACGTGTCACGT | GC TGTCG GTGTCA GTC | 0011
ATGTTGGACACTCGGCGGACGACTGAGCACTGGAACTTTTTAAA | GACTG ACT ACGACTGAGCACT | 111
ATGTTGGACACTCGGCGGACGACTGAGCACTGGAACTTTTTAAA | ACGACTGAGCACT GAC ACG ACGACT ACT | 11111
GGCTCAAATTACACGTAAACTTAAGAATATTCG | TAC ACA TTACA ATA TAT ATAT | 111111
CAGTCATAAAATACATTCAAGTATCAATAAATAG | CAGTCATAA AGT CAT GTCAT | 1111
ACGACTGAGCACT | GACTG ACT | 11
ATGTTGGACACTCGGCGGACGACTGAGCACTGGAACTTTTTAAA | ACT ACGACTGAGCACT GACTG | 111
CACCCACAATCAGGCGAAGAGCCCCGAC | CAC GAG GCC | 111
AAAAAAAAAA | A AA AAA AAAA AAAAA AAAAAA | 111111
ACCCA | A C G C C C | 110111
ACCCA | ACCCA ACCCA A ACCA TG | 11100
GGGGG | GG GG GGG GGGGG GGGGG GGGGGG | 111110
AGGGGGANA | GGGG AG GAA GA GGGG GAA GGGG | 1101101
"""
CASES = [(g.strip(), m.split(), b.strip()) for g, m, b in (line.split("|") for line in VECTORS.strip().splitlines())]
# Edge cases: empty markers and genomes, breaks, letters outside A, C, G, T, lengths, overlaps.
CASES += [
    ("ACGT", ["", "A"], "01"),
    ("", ["A", "C"], "00"),
    ("NNNN", ["A"], "0"),
    ("ACNACG", ["ACA", "ACG", "AC"], "011"),
    ("ACNGT", ["CNG", "ac", "GT"], "001"),
    ("ACRACG", ["CA", "CAA", "ACG"], "001"),
    ("GGTT", ["GG", "A", "GG", "TT", "A"], "10110"),
    ("AC", ["ACG"], "0"),
    ("ACG", ["ACG"], "1"),
    ("ACG", ["CG", "GT", "TA"], "100"),
    ("ACGT", ["CG", "GT", "TA"], "110"),
    ("ACGTA", ["CG", "GT", "TA"], "111"),
    ("AAAA", ["AA"], "1"),
]
STRATEGIES = ["auto", "nested", "seeded", "sampled", "shuffled", "by_length"]


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_vectors(spark, strategy):
    genomes = readers.genomes_from(spark, [g for g, _, _ in CASES])
    every = [m for _, ms, _ in CASES for m in ms]
    bits = [r.bits for r in matrix.presence_bits(genomes, readers.markers_from(spark, every), strategy).orderBy("genome_id").collect()]
    at = 0
    for row, (_, ms, expected) in zip(bits, CASES, strict=True):
        assert len(row) == len(every)
        assert row[at : at + len(ms)] == expected
        at += len(ms)


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_random_against_python(spark, strategy):
    rng = random.Random(7)
    genomes = ["".join(rng.choice("ACGTACGTACGTN") for _ in range(rng.randint(0, 400))) for _ in range(30)]
    markers = [g[i : i + rng.randint(1, 90)] for g in genomes if len(g) > 120 for i in rng.sample(range(len(g) - 20), 4)]
    markers += ["".join(rng.choice("ACGT") for _ in range(rng.randint(1, 14))) for _ in range(40)]
    stride = 32
    rows = matrix.presence_bits(readers.genomes_from(spark, genomes), readers.markers_from(spark, markers), strategy, stride).orderBy("genome_id").collect()
    valid = lambda m: m and set(m) <= set("ACGT")
    assert [r.bits for r in rows] == ["".join("1" if valid(m) and m in g else "0" for m in markers) for g in genomes]


def test_match_at_every_offset_of_a_chunk_edge(spark):
    marker, stride = "ACGTTGCAACGG", 50
    genomes = ["T" * k + marker + "T" * (130 - k) for k in range(120)]
    rows = matrix.presence_bits(readers.genomes_from(spark, genomes), readers.markers_from(spark, [marker]), "seeded", stride).collect()
    assert len(rows) == 120 and all(r.bits == "1" for r in rows)


def test_long_marker(spark):
    rng = random.Random(3)
    marker = "".join(rng.choice("ACGT") for _ in range(3000))
    other = marker[:-1] + ("A" if marker[-1] != "A" else "C")
    genome = "".join(rng.choice("ACGT") for _ in range(10)) + marker + "TTTTTTTTTT"
    for strategy in STRATEGIES:
        rows = matrix.presence_bits(readers.genomes_from(spark, [genome]), readers.markers_from(spark, [marker, other]), strategy, 1024).collect()
        assert [r.bits for r in rows] == ["10"], strategy


@pytest.mark.parametrize("n", [99, 100, 101, 199])
def test_one_row_for_each_genome(spark, n):
    rows = matrix.presence_bits(readers.genomes_from(spark, ["ACGT"] * n), readers.markers_from(spark, ["CG", "TT"])).collect()
    assert len(rows) == n and {r.bits for r in rows} == {"10"}


def test_no_markers_or_genomes(spark):
    assert [r.bits for r in matrix.presence_bits(readers.genomes_from(spark, ["ACG"]), readers.markers_from(spark, [])).collect()] == [""]
    assert matrix.presence_bits(readers.genomes_from(spark, []), readers.markers_from(spark, ["A"])).collect() == []


def test_planner_choices():
    few = {"short": {"n": 3, "bases": 9, "least": 3, "most": 3, "lengths": [3]}}
    assert [s.kind for s in planner.choose(few).steps] == ["nested"]
    many = {"long": {"n": 5000, "bases": 100_000, "least": 15, "most": 30, "lengths": []}}
    assert [s.kind for s in planner.choose(few | many).steps] == ["nested", "seeded"]
    huge = {"long": {"n": 8_000_000, "bases": 200_000_000, "least": 20, "most": 40, "lengths": []}}
    assert [s.kind for s in planner.choose(huge).steps] == ["shuffled"]
    assert [s.kind for s in planner.choose(huge, "seeded").steps] == ["shuffled"]
    with pytest.raises(ValueError):
        planner.choose(huge, "nested")
    assert planner.choose({}).empty


def test_large_tables_are_not_broadcast(spark):
    genomes, markers = readers.genomes_from(spark, ["ACGT" * 10]), readers.markers_from(spark, ["ACGTACGTACGTACG"])
    pieces = matching.chunks(genomes, 15)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = matching.seeded(pieces, matching.distinct_markers(markers), 15, 15, broadcast=False)._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and "CartesianProduct" not in plan


def test_index_options(spark):
    index = api.MarkerIndex.of(spark, ["ac", "GT"], case_insensitive=True)
    assert [r.bits for r in index.match(readers.genomes_from(spark, ["ACGT"])).collect()] == ["11"]
    with pytest.raises(ValueError):
        api.MarkerIndex.of(spark, ["ANC"], strict=True)
    with pytest.raises(TypeError):
        api.Marker("1", "AC")
    assert api.analyze(spark, ["ACG", "TTT"], ["CG", "TT"]) == ["10", "01"]
    assert index.markers.where(F.col("ordinal") == 0).first().seq == "AC"


@pytest.mark.parametrize("longest", [12, 40])
def test_few_markers_are_scanned_for(spark, longest):
    """No join of every chunk with every marker, whose pairs are then made distinct; markers that share their first bases are told apart."""
    rng = random.Random(longest)
    genomes = ["".join(rng.choice("ACGTN") for _ in range(rng.randint(0, 500))) for _ in range(40)]
    head = "ACGTTGCAAC"
    genomes += [head + "GG" + "T" * k for k in range(30)] + [head, head[:-1]]
    markers = ["A", "AC", head, head + "G", head + "GT", head + "GG" + "T" * (longest - 12), *("".join(rng.choice("ACGT") for _ in range(rng.randint(1, 6))) for _ in range(80))]
    pieces = matching.chunks(readers.genomes_from(spark, genomes), longest, 64)
    hits = matching.nested(pieces, matching.distinct_markers(readers.markers_from(spark, markers)))
    assert "BroadcastNestedLoopJoin" not in hits._jdf.queryExecution().toString()
    rows = [tuple(r) for r in hits.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {(i, m) for i, g in enumerate(genomes) for m in markers if m in g}


def test_only_grams_of_markers_become_rows(spark):
    rng = random.Random(5)
    genomes = ["".join(rng.choice("ACGTN") for _ in range(3000)) for _ in range(20)]
    markers = ["ACG", "CATTAG", "GATTACAGA", "GATTACAG"]
    hits = matching.by_length(matching.chunks(readers.genomes_from(spark, genomes), 9), matching.distinct_markers(readers.markers_from(spark, markers)), [3, 6, 8, 9])
    assert "regexp_extract_all" not in hits._jdf.queryExecution().optimizedPlan().toString().replace("regexp_extract_all(seq", "")
    assert sorted(tuple(r) for r in hits.collect()) == sorted((i, m) for i, g in enumerate(genomes) for m in markers if m in g)


def test_bits_of_few_markers_need_no_row_for_a_hit(spark):
    rng = random.Random(6)
    genomes = ["".join(rng.choice("ACGTN") for _ in range(rng.randint(0, 300))) for _ in range(25)]
    markers = ["A", "", "AN", "A", *("".join(rng.choice("ACGT") for _ in range(rng.randint(1, 5))) for _ in range(90))]
    bits = matrix.presence_bits(readers.genomes_from(spark, genomes), readers.markers_from(spark, markers), "auto", 40)
    assert "collect_set" not in bits._jdf.queryExecution().toString()
    valid = lambda m: m and set(m) <= set("ACGT")
    assert [r.bits for r in bits.orderBy("genome_id").collect()] == ["".join("1" if valid(m) and m in g else "0" for m in markers) for g in genomes]
    for some in (["", "N"], ["A", "N"]):
        rows = matrix.presence_bits(readers.genomes_from(spark, ["ACG", "", "NN"]), readers.markers_from(spark, some)).orderBy("genome_id").collect()
        assert [r.bits for r in rows] == (["10", "00", "00"] if some[0] else ["00"] * 3)

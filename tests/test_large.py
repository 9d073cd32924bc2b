"""What large genomes, marker tables and matrices need: split scans, seeds let through, packed blocks, stored runs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from presentia import api
from presentia.functions import dna
from presentia.operators import blocked, matching, matrix, seeding, statistics
from presentia.sources import pieces, readers, stored


def bases(rng, n, letters="ACGT"):
    return "".join(rng.choices(letters, k=n))


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3k")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("separator, stride, longest", [(None, 500, 40), (None, 64, 3000), ("GATC", 500, 40), ("GATC", 2000, 9000), (None, 100, 1)])
def test_split_scan_has_the_whole_files_stretches(spark, tmp_path, small_splits, separator, stride, longest):
    rng = random.Random(longest)
    texts = {f"g{i}.fa": bases(rng, n, "ACGTacgtN") for i, n in enumerate([20_000, 12_345, 700, 3, 0])}
    for name, text in texts.items():
        if separator:
            (tmp_path / name).write_text(text + ("GATC" if name == "g1.fa" else "\n" if name == "g2.fa" else ""))
        else:
            lines = [text[i : i + 60] for i in range(0, len(text), 60)]
            (tmp_path / name).write_text("\n".join([">head one", *lines[:5], ">head ACGT two\r", *lines[5:]]) + "\n")
    paths = [str(tmp_path / n) for n in texts]
    got = pieces.read_pieces(spark, paths, longest, stride, separator)
    rows = got.withColumn("name", dna.basename(F.col("path"))).collect()
    assert len({r.chunk_no for r in rows if r.name == "g0.fa"}) > 5 and pieces.records(spark, paths, separator).rdd.getNumPartitions() > 8
    whole = {r.name: r.seq for r in readers.read_genome_files(spark, paths).collect()}
    for name, seq in whole.items():
        own = [r.chunk for r in rows if r.name == name]
        stretches = lambda s: {x[i : i + longest] for x in s.split("N") for i in range(max(0, len(x) - longest) + 1) if x}  # noqa: E731, B023
        assert {x for x in stretches(seq)} <= {y for c in own for y in stretches(c)} | {y for c in own for y in [*c.split("N")]}
        assert all(part in seq or part.strip("N") in seq for c in own for part in c.split("N"))
    # the same hits as from whole files
    markers = [s[k : k + n] for s in whole.values() for k in range(0, max(0, len(s) - 50), 997) for n in {longest, max(1, longest // 3)} if "N" not in s[k : k + n] and len(s) >= k + n]
    table = readers.markers_from(spark, [*markers, "A" * longest])
    hits = matching.match_pieces(lambda m: pieces.read_pieces(spark, paths, m, stride, separator).select(dna.basename(F.col("path")).alias("genome_id"), "chunk_no", "chunk"), table)
    expected = {(n, m) for n, s in whole.items() for m in {*markers, "A" * longest} if m in s}
    assert {tuple(r) for r in hits.collect()} == expected and (longest > 100 or expected)


def test_no_task_reads_a_whole_file(spark, tmp_path, small_splits):
    (tmp_path / "one.fa").write_text("\n".join(bases(random.Random(1), 60) for _ in range(1000)))
    rows = pieces.records(spark, str(tmp_path / "one.fa")).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(rows) > 15 and max(r["count"] for r in rows) < 100


def test_blocked_matrix(spark, tmp_path):
    rng = random.Random(2)
    hits = {(rng.randrange(20), rng.randrange(1000)) for _ in range(800)} | {(5, 63), (5, 64), (5, 999), (6, 127)}
    other = {(rng.randrange(25), rng.randrange(1200)) for _ in range(700)}
    frame = lambda h: spark.createDataFrame([*h, *list(h)[:50]], "genome_id LONG, ordinal LONG")
    genomes = spark.range(22).select(F.col("id").alias("genome_id"))
    path = str(tmp_path / "m")
    blocked.save(blocked.pack(frame(hits), 128), path)
    stored_matrix = blocked.load(spark, path)
    assert {tuple(r) for r in blocked.unpack(stored_matrix, 128).collect()} == hits
    for o in (0, 63, 64, 127, 128, 999, 5000):
        assert {(r.genome_id, r.present) for r in blocked.column(stored_matrix, genomes, o, 128).collect()} == {(g, int((g, o) in hits)) for g in range(22)}
    assert [r.present for r in blocked.cell(stored_matrix, genomes, 5, 64, 128).collect()] == [1] and blocked.cell(stored_matrix, genomes, 99, 64, 128).collect() == []
    second = blocked.pack(frame(other), 128)
    for how, both in (("or", hits | other), ("and", hits & other), ("xor", hits ^ other)):
        assert {tuple(r) for r in blocked.unpack(blocked.combine(stored_matrix, second, how), 128).collect()} == both
        n = {r.genome_id: r.ones for r in blocked.ones(blocked.combine(stored_matrix, second, how)).collect()}
        assert n == {g: sum(x == g for x, _ in both) for g in {g for g, _ in both}}
    plan = blocked.column(stored_matrix, genomes, 999, 128)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(block" in plan and "= 7)" in plan  # one folder is read
    assert blocked.pack(frame(set()).where("false")).collect() == []


def test_seeds_and_minimizers():
    rng = random.Random(1)
    for t in range(200):
        s = rng.choice([10, 12, 13, 14, 20, 31])
        k, w = -(-2 * s // 3), s // 3 + 1
        text = bases(rng, rng.randint(s, 200), "ACGT" if t % 3 else "AAC")
        at = rng.randrange(len(text) - s + 1)
        data, stops = np.frombuffer(text.encode(), np.uint8), np.full(len(text), len(text))
        value, ok = seeding.seeds_of(data, stops, k)
        assert value[ok].tolist() == [sum("ACGT".index(c) * 4 ** (k - 1 - i) for i, c in enumerate(text[j : j + k])) for j in range(len(text) - k + 1)]
        chosen = seeding.minimizers(value, ok, stops, k, w)
        assert chosen[at + (seeding.mixed(value[at : at + w]) >> np.uint64(1)).argmin()]
    data, stops = np.frombuffer(b"ACGNACGTAC", np.uint8), np.array([3] * 3 + [10] * 7)
    assert np.flatnonzero(seeding.seeds_of(data, stops, 3)[1]).tolist() == [0, 4, 5, 6, 7]
    text = bases(rng, 100_000)
    data, stops = np.frombuffer(text.encode(), np.uint8), np.full(len(text), len(text))
    value, ok = seeding.seeds_of(data, stops, 20)
    assert seeding.minimizers(value, ok, stops, 20, 9).mean() == pytest.approx(0.2, abs=0.01)  # two of w + 1


def test_only_starts_near_hits_are_rows(spark):
    rng = random.Random(3)
    genomes = [bases(rng, 20_000) for _ in range(5)]
    markers = [bases(rng, 20) for _ in range(300)] + [g[777:797] for g in genomes]
    table = spark.createDataFrame([(m, 20) for m in markers], "seq STRING, length INT")
    cut = matching.chunks(readers.genomes_from(spark, genomes), 20, 1000)
    for k, w in ((20, 1), (14, 7)):
        seeds = seeding.marker_seeds(table, k, w)
        assert seeding.starts(cut, seeding.table_of(seeds.select("seed").distinct()), k, w, 20).count() < 2000  # of 100,000 bases
    for sampled in (False, True):
        hits = matching.seeded(cut, table, 20, 20, False, sampled)
        assert {r.seq for r in hits.collect()} == set(markers[300:])


def test_runs_of_one_base_and_long_markers_by_minimizers(spark):
    rng = random.Random(4)
    long = bases(rng, 500)
    genomes = ["A" * 60 + "C" + "A" * 60, bases(rng, 50) + long + bases(rng, 50), "ACAC" * 40, bases(rng, 50) + long[:-1]]
    markers = ["A" * 30, "A" * 12 + "C", "AC" * 15, long, long[:70], "A" * 11]
    bits = matrix.presence_bits(readers.genomes_from(spark, genomes), readers.markers_from(spark, markers), "sampled", 700)
    assert [r.bits for r in bits.orderBy("genome_id").collect()] == ["".join(str(int(m in g)) for m in markers) for g in genomes]


def test_prefixes_without_expansion(spark):
    rng = random.Random(5)
    markers = [bases(rng, rng.randint(0, 12), "AC") for _ in range(300)] + ["AC", "AC", ""]
    expected = len({m[:i] for m in markers for i in range(1, len(m) + 1)})
    assert statistics.distinct_prefixes(readers.markers_from(spark, markers)).first().n_prefixes == expected
    million = bases(rng, 1_000_000)
    pair = readers.markers_from(spark, [million, million[:-1] + "AC"[million[-1] == "A"], million[:500_000]])
    assert statistics.distinct_prefixes(pair).first().n_prefixes == 1_000_001
    assert statistics.distinct_prefixes(readers.markers_from(spark, [])).first().n_prefixes == 0


def test_whole_genomes_are_packed_with_breaks(spark):
    rng = random.Random(6)
    texts = ["", "N", "NN", "NNN", "ACGTN", "ACNNGT", None, *(bases(rng, n, "ACGTN") for n in (100, 101, 102, 50_000))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, seq STRING")
    rows = df.select("seq", dna.pack_genome(F.col("seq")).alias("p")).select("seq", "p", dna.unpack_genome(F.col("p")).alias("back")).collect()
    assert all(r.back == (r.seq or "") and r.p.length == len(r.seq or "") and len(r.p.triples) == -(-len(r.seq or "") // 3) for r in rows)


def test_bad_marker_lines(spark, tmp_path):
    (tmp_path / "m.csv").write_text('1,ACG\nx2,TT\n3,"GG"\n\n4,A,C\n,CC\n 5 ,AA\n')
    path = str(tmp_path / "m.csv")
    bad = {(r.line_number, r.line): r.reason for r in readers.bad_markers(spark, path).collect()}
    assert set(bad) == {(2, "x2,TT"), (5, "4,A,C"), (6, ",CC")}
    rows = {r.ordinal: (r.marker_id, r.seq) for r in readers.read_markers(spark, path).collect()}
    assert rows == {0: (1, "ACG"), 1: (None, "TT"), 2: (3, "GG"), 3: (None, ""), 4: (4, "A"), 5: (None, "CC"), 6: (5, "AA")}
    with pytest.raises(Exception, match="line 2"):
        readers.read_markers(spark, path, strict=True).where("ordinal < 2").collect()
    (tmp_path / "good.csv").write_text("1,ACG\n2,TT\n")
    assert readers.read_markers(spark, str(tmp_path / "good.csv"), strict=True).count() == 2


def test_stored_runs_match_only_what_is_new(spark, tmp_path):
    store, markers = str(tmp_path / "store"), readers.markers_from(spark, ["AC", "GG"])
    genomes = lambda **g: spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(g.items())], "genome_id LONG, name STRING, seq STRING")
    bits = lambda df: {r.name: r.bits for r in df.collect()}
    files = lambda: {p.parent.name: p.name for p in (tmp_path / "store").glob("name=*/*.parquet")}
    assert bits(stored.update(genomes(a="AC", b="GG", c="TT"), markers, store)) == {"a": "10", "b": "01", "c": "00"}
    first = files()
    changed = genomes(a="AC", b="ACGG", d="GGG")
    todo = stored.stale(changed, stored.marker_set(markers), stored.stored(spark, store))
    assert {r.name for r in todo.collect()} == {"b", "d"}
    assert bits(stored.update(changed, markers, store)) == {"a": "10", "b": "11", "d": "01"}
    second = files()
    assert second["name=a"] == first["name=a"] and second["name=b"] != first["name=b"] and set(second) == {f"name={x}" for x in "abcd"}
    other = readers.markers_from(spark, ["AC", "GG", "T"])
    assert bits(stored.update(changed, other, store)) == {"a": "100", "b": "110", "d": "010"}
    assert stored.marker_set(markers) != stored.marker_set(other) and stored.marker_set(markers) == stored.marker_set(markers.orderBy(F.desc("ordinal")))
    with pytest.raises(ValueError):
        stored.update(spark.createDataFrame([(0, "x", "A"), (1, "x", "C")], "genome_id LONG, name STRING, seq STRING"), markers, store)
    assert stored.update(genomes(a="AC").where("false"), markers, str(tmp_path / "none")).collect() == []


def test_files_in_one_split_are_dealt_out(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    assert table.rdd.getNumPartitions() == 1 and readers.spread_rows(table).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert api.analyze(spark, ["ACG"], ["CG"]) == ["1"]


def test_packing_and_one_hot_go_by_columns(spark):
    """Numbers are made for a batch at once, no text or array for each triple or base; odd texts are as they were."""
    rng = random.Random(8)
    texts = ["", "A", "AC", "ACG", "TTTT", None, *(bases(rng, rng.randint(0, 50)) for _ in range(60))]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string").repartition(3)
    packed = frame.select("i", "s", dna.pack3(F.col("s")).alias("p"))
    code = lambda x: [sum("ACGT".index(b) << 2 * (3 - j) for j, b in enumerate(x[k : k + 3])) + (3 - len(x[k : k + 3])) for k in range(0, len(x), 3)]
    rows = packed.withColumn("back", dna.unpack3(F.col("p"))).collect()
    assert all(r.p == (None if r.s is None else code(r.s)) and r.back == r.s for r in rows)
    assert "regexp_extract_all" not in packed._jdf.queryExecution().optimizedPlan().toString()
    odd = spark.createDataFrame([(0, "ACNGT"), (1, ""), (2, "Aé\u20acC"), (3, "NN")], "i int, s string").select("i", dna.one_hot(F.col("s")).alias("h"))
    got = {r.i: (r.h.a, r.h.t, r.seq) for r in odd.withColumn("seq", dna.from_one_hot(F.col("h"))).collect()}
    assert got == {0: ([1, 0, 0, 0, 0], [0, 0, 0, 0, 1], "ACNGT"), 1: ([], [], ""), 2: ([1, 0, 0, 0], [0] * 4, "ANNC"), 3: ([0, 0], [0, 0], "NN")}
    short = spark.sql("SELECT struct(array(1, 0, null) AS a, array(0, 1) AS c, cast(null AS array<int>) AS g, array(0, 0, 2) AS t) AS h")
    assert short.select(dna.from_one_hot(F.col("h"))).first()[0] == "ACT"

"""Files in and out, the command, the matrix and the stream."""

import gzip

import pytest
from pyspark.sql import functions as F

from presentia import __main__ as command
from presentia import api
from presentia.functions import dna
from presentia.operators import matrix, statistics
from presentia.sources import readers, writers
from presentia.streaming import genomes as streaming


@pytest.fixture
def files(tmp_path):
    (tmp_path / "set").mkdir()
    (tmp_path / "set" / "a.fasta").write_text(">head\nac\nGT\n")
    with gzip.open(tmp_path / "set" / "b.fasta.gz", "wt") as f:
        f.write(">h1\nTTTT\n>h2\nRACG\n")
    (tmp_path / "set" / "c d.txt").write_text("")
    (tmp_path / "genomes.txt").write_text("set/a.fasta\nset/b.fasta.gz\nset/c d.txt\n")
    (tmp_path / "markers.csv").write_text('7,ACGT\n3,"TT"\n9,\n4,CG\n')
    return tmp_path


def test_run_over_files(spark, files):
    out = files / "out"
    rows = api.run(spark, str(files / "genomes.txt"), str(files / "markers.csv"), str(out), ordered=True).orderBy("genome_id").collect()
    assert [(r.name, r.bits) for r in rows] == [("a.fasta", "1001"), ("b.fasta.gz", "0101"), ("c d.txt", "0000")]
    read = readers.read_result(spark, str(out))
    assert {(r.name, r.bits) for r in read.where("name like '%fasta%'").collect()} == {("a.fasta", "1001"), ("b.fasta.gz", "0101")}


def test_command(spark, files):
    command.main([str(files / "genomes.txt"), str(files / "markers.csv"), str(files / "out2"), "--strategy", "nested"])
    assert spark.read.text(str(files / "out2")).count() == 3


def test_manifest_options(spark, files):
    assert readers.read_genomes(spark, str(files / "genomes.txt"), first=1).count() == 1
    listed = readers.read_manifest(spark, str(files / "genomes.txt"), base_dir="s3://bucket/x")
    assert listed.orderBy("ordinal").first().path == "s3://bucket/x/set/a.fasta"
    (files / "none.txt").write_text("\n")
    with pytest.raises(ValueError):
        readers.read_genomes(spark, str(files / "none.txt"))
    rest = readers.to_download(listed, spark.createDataFrame([("a.fasta",)], "name STRING"))
    assert rest.count() == 2
    writers_path = str(files / "names")
    readers.write_manifest(listed, writers_path)
    assert spark.read.text(writers_path).count() == 3


def test_first_line_only(spark, files):
    (files / "two.txt").write_text("ACGT\nTTTT\n")
    assert [r.seq for r in readers.read_genome_files(spark, str(files / "two.txt"), first_line_only=True).collect()] == ["ACGT"]


def test_markers(spark, files):
    rows = readers.read_markers(spark, str(files / "markers.csv")).orderBy("ordinal").collect()
    assert [(r.ordinal, r.marker_id, r.seq) for r in rows] == [(0, 7, "ACGT"), (1, 3, "TT"), (2, 9, ""), (3, 4, "CG")]
    assert readers.read_markers(spark, str(files / "markers.csv"), first=2).count() == 2
    with pytest.raises(TypeError):
        readers.markers_from(spark, ["A"], ["1"])


def test_one_hot_and_packing(spark):
    df = readers.genomes_from(spark, ["ACNTA", "", "G", "ACG", "ACGT", "ACGTA"])
    rows = df.select("seq", dna.one_hot(F.col("seq")).alias("r")).select("seq", "r.*")
    assert all(r.seq == r.back for r in rows.select("seq", dna.from_one_hot(F.struct("a", "c", "g", "t")).alias("back")).collect())
    assert readers.genomes_from_one_hot(rows.drop("seq")).count() == 6
    packed = df.where(~F.col("seq").contains("N")).select("seq", dna.unpack3(dna.pack3(F.col("seq"))).alias("back"))
    assert all(r.seq == r.back for r in packed.collect())
    assert [r.x for r in df.where("seq = 'ACGT'").select(F.size(dna.pack3(F.col("seq"))).alias("x")).collect()] == [2]


def test_field_rules(spark):
    df = spark.createDataFrame([("1,AC,GT",), ("AC",), ("",)], "line STRING")
    rows = df.select(dna.after_comma(F.col("line")), dna.second_field(F.col("line")), dna.last_field(F.col("line"))).collect()
    assert [tuple(r) for r in rows] == [("AC,GT", "AC", "GT"), ("AC", "", "AC"), ("", "", "")]


def test_matrix(spark, tmp_path):
    finder = api.MarkerFinder(readers.markers_from(spark, ["AC", "GG", "AC"]), readers.genomes_from(spark, ["AC", "GG"], ["x", "y"]))
    with pytest.raises(ValueError):
        _ = finder.presence_matrix
    m = finder.run().check()
    assert finder.run() is m and finder.presence_matrix is m
    assert m.marker_number == 3 and m.cell("x", 2) == 1 and m.cell("y", 0) == 0
    for bad in (("z", 0), ("x", 3)):
        with pytest.raises(KeyError):
            m.cell(*bad)
    more = m.add(spark.createDataFrame([(1, 0)], "genome_id LONG, ordinal INT"))
    assert {r.name: r.bits for r in more.bits.collect()} == {"x": "101", "y": "110"}
    assert {r.bits for r in m.reset().bits.collect()} == {"000"}
    m.save(str(tmp_path / "m"))
    assert api.PresenceMatrix.load(spark, str(tmp_path / "m")).cell("y", 1) == 1
    assert [r.present for r in m.marker_column(0).orderBy("genome_id").collect()] == [1, 0]
    assert m.genomes.count() == 2 and m.markers.count() == 3
    finder.genomes = readers.genomes_from(spark, ["AC", "AC"], ["x", "x"])
    with pytest.raises(ValueError):
        finder.run().check()
    finder.clear_state()


def test_reconcile_and_statistics(spark):
    a = spark.createDataFrame([("x", "10"), ("y", "01"), ("z", "00")], "name STRING, bits STRING")
    b = spark.createDataFrame([("x", "10"), ("y", "11"), ("w", "00")], "name STRING, bits STRING")
    assert {r.name for r in matrix.reconcile(a, b).collect()} == {"y", "z", "w"}
    row = statistics.marker_statistics(readers.markers_from(spark, ["AC", "ACG"])).first()
    assert (row.n_markers, row.n_bases, row.size_sum) == (2, 5, 29)
    assert statistics.marker_statistics(readers.markers_from(spark, [])).first().n_bases == 0
    assert statistics.distinct_prefixes(readers.markers_from(spark, ["AC", "ACG"])).first().n_prefixes == 3
    assert {r.value for r in writers.result_lines(a).collect()} == {"x 10", "y 01", "z 00"}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in (("a.txt", ">h\nAC\nGT\n"), ("b.txt", "TTTT")):
        (tmp_path / "in" / name).write_text(text)
    markers = readers.markers_from(spark, ["CG", "TT"])
    stream = streaming.read_genome_stream(spark, str(tmp_path / "in"))
    streaming.write_bits(stream, markers, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert {(r.name, r.bits) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a.txt", "10"), ("b.txt", "01")}
    hits = streaming.hits_stream(stream.withColumn("genome_id", F.col("name")), markers)
    query = hits.writeStream.format("memory").queryName("hits").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {tuple(r) for r in spark.table("hits").distinct().collect()} == {("a.txt", "CG"), ("b.txt", "TT")}


def test_marker_lines_are_numbered_over_splits(spark, tmp_path):
    lines = [f"{i},{'ACGT' * (i % 5 + 1)}" for i in range(3000)]
    lines[7], lines[11] = "", "7"
    (tmp_path / "m.csv").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        frame = readers.read_markers(spark, str(tmp_path / "m.csv"))
        rows = frame.collect()
        assert spark.read.text(str(tmp_path / "m.csv")).rdd.getNumPartitions() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = {r.ordinal: r for r in rows}
    assert sorted(got) == list(range(3000)) and got[7].seq == got[11].seq == ""
    assert all(got[i].seq == "ACGT" * (i % 5 + 1) and got[i].marker_id == i for i in range(3000) if i not in (7, 11))


def test_finder_computes_its_matrix_once(spark):
    finder = api.MarkerFinder(readers.markers_from(spark, ["AC", "GG"]), readers.genomes_from(spark, ["ACGT", "GGA"]))
    matrix = finder.run()
    assert matrix.bits.is_cached and finder.run() is matrix
    added = matrix.add(spark.createDataFrame([(0, 1)], "genome_id LONG, ordinal INT"))
    assert [r.bits for r in added.bits.orderBy("genome_id").collect()] == ["11", "01"]
    finder.markers = readers.markers_from(spark, ["T"])
    assert not matrix.bits.is_cached and [r.bits for r in finder.run().bits.orderBy("genome_id").collect()] == ["1", "0"]
    finder.clear_state()

"""Registered queries over the test tables, and DuckDB SQL with the same rows.

documents stand for genomes and benchmark for markers: letters are mapped to
A, C, G, T in turn and all else to breaks.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presentia.functions import dna
from presentia.operators import blocked, matrix, statistics
from presentia.operators.matching import distinct_markers, match, match_pieces
from presentia.sources import pieces, readers, stored, writers

LETTERS = string.ascii_lowercase + string.ascii_uppercase
BASES = "ACGT" * 13


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


def as_dna(text, mark: str = "N"):
    return dna.as_bases(text, dict(zip(LETTERS, BASES, strict=True)), mark)


def documents(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The genomes' table; a table in one row group would be one task."""
    return readers.spread_rows(table(spark, d, "documents").select("doc_id", "text", *columns))


def genomes(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select(F.col("doc_id").alias("genome_id"), as_dna(F.col("text")).alias("seq"))


def markers(spark: SparkSession, d: str) -> DataFrame:
    seq = F.split_part(as_dna(F.col("text")), F.lit("N"), F.lit(2))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("ordinal"), seq.alias("seq"))


def _hits(strategy: str, **how):
    def query(spark: SparkSession, d: str) -> DataFrame:
        m = markers(spark, d)
        return matrix.fan_out(match(genomes(spark, d), m, strategy, **how), m)

    return query


def whole_genomes(spark: SparkSession, d: str) -> DataFrame:
    """Genomes without breaks: only the letters of a text."""
    bare = as_dna(F.col("text"), "")
    return documents(spark, d).select(F.col("doc_id").alias("genome_id"), bare.alias("seq"))


def long_markers(spark: SparkSession, d: str) -> DataFrame:
    """Markers of 12 to 40 bases, all of a benchmark text cut in a row, ordinals by text and place."""
    bare = F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), LETTERS, BASES), "[^ACGT]+", "")
    pieces = F.expr("transform(sequence(0, cast(length(bare) / width as int)), i -> substring(bare, i * width + 1, width))")
    rows = table(spark, d, "benchmark").select("item_id", bare.alias("bare"), (F.col("item_id") % 29 + 12).cast("int").alias("width"))
    each = rows.select("item_id", "width", F.posexplode(pieces).alias("at", "seq")).where(F.length("seq") == F.col("width"))
    return each.select((F.col("item_id") * 100_000 + F.col("at")).alias("ordinal"), "seq")


def _long_hits(strategy: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        m = long_markers(spark, d)
        return matrix.fan_out(match(whole_genomes(spark, d), m, strategy), m)

    return query


def _clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(dna.is_clean(F.col("text"))).select(F.col("doc_id").alias("genome_id"))


def _prefix(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.when(F.col("doc_id") % 2 == 0, F.lit("data/set/")).otherwise(F.lit("other/")), F.lit("g"), F.col("doc_id").cast("string"))
    return table(spark, d, "documents").select(dna.without_prefix(path, "data/set/").alias("path"))


def _bits(spark: SparkSession, d: str) -> DataFrame:
    return matrix.presence_bits(genomes(spark, d), markers(spark, d))


def _long(spark: SparkSession, d: str) -> DataFrame:
    return matrix.to_long(_bits(spark, d))


def _long_to_bits(spark: SparkSession, d: str) -> DataFrame:
    width = markers(spark, d).count()
    return matrix.from_long(_long(spark, d), width)


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return genomes(spark, d).select("genome_id", F.explode(dna.segments(F.col("seq"))).alias("segment"))


def _collapse(spark: SparkSession, d: str) -> DataFrame:
    raw = F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), LETTERS, BASES), "[^ACGT]", "N")
    return table(spark, d, "documents").select(F.col("doc_id").alias("genome_id"), dna.collapse_breaks(raw).alias("seq"))


def _dedupe(spark: SparkSession, d: str) -> DataFrame:
    return matrix.dedupe_markers(markers(spark, d)).select("seq", F.col("first_ordinal"), F.size("ordinals").cast("long").alias("n"), F.array_join("ordinals", ",").alias("ordinals"))


def _fan_out(spark: SparkSession, d: str) -> DataFrame:
    m = markers(spark, d)
    firsts = matrix.dedupe_markers(m).select("seq", F.col("first_ordinal").alias("genome_id"))
    return matrix.fan_out(firsts, m).select(F.col("genome_id").alias("first_ordinal"), "ordinal")


def _membership(spark: SparkSession, d: str) -> DataFrame:
    m = markers(spark, d)
    return matrix.members(m, match(genomes(spark, d), m).select("seq").distinct()).select("ordinal", "seq")


def _absent(spark: SparkSession, d: str) -> DataFrame:
    return _long(spark, d).where("present = 0").select("genome_id", F.col("ordinal").cast("long").alias("ordinal"))


def _merge(spark: SparkSession, d: str) -> DataFrame:
    once = _bits(spark, d).persist()  # both sides read it
    even = matrix.to_long(once).withColumn("present", F.when(F.col("ordinal") % 2 == 0, F.col("present")).otherwise(F.lit(0)).cast("tinyint"))
    odd = matrix.to_long(once).withColumn("present", F.when(F.col("ordinal") % 3 == 0, F.col("present")).otherwise(F.lit(0)).cast("tinyint"))
    return matrix.merge(even, odd).select("genome_id", F.col("ordinal").cast("long").alias("ordinal"), F.col("present").cast("long").alias("present"))


def _named(spark: SparkSession, d: str) -> DataFrame:
    return _bits(spark, d).withColumn("name", F.concat(F.lit("g"), F.col("genome_id").cast("string")))


def _reconcile(spark: SparkSession, d: str) -> DataFrame:
    a = _named(spark, d).persist()  # both sides read it
    # another result, without the genomes that lack the first marker, and with bits turned round where the last one is there
    b = a.where("bits LIKE '1%'").withColumn("bits", F.when(F.col("bits").endswith("1"), F.reverse("bits")).otherwise(F.col("bits")))
    return matrix.reconcile(a, b.select("name", "bits"))


def _marker_stats(spark: SparkSession, d: str) -> DataFrame:
    return statistics.marker_statistics(markers(spark, d))


def _genome_stats(spark: SparkSession, d: str) -> DataFrame:
    return statistics.genome_statistics(genomes(spark, d))


def _prefixes(spark: SparkSession, d: str) -> DataFrame:
    return statistics.distinct_prefixes(markers(spark, d))


def _uniqueness(spark: SparkSession, d: str) -> DataFrame:
    return matrix.repeated_genomes(table(spark, d, "documents").select(F.col("source").alias("name")))


def _codes(spark: SparkSession, d: str) -> DataFrame:
    return genomes(spark, d).select("genome_id", dna.base_codes(F.col("seq")).alias("codes"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    named = _bits(spark, d).withColumn("name", dna.basename(F.concat(F.lit("data/set/g"), F.col("genome_id").cast("string"))))
    return writers.result_lines(named)


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    parts = F.split("value", " ")
    return _lines(spark, d).select(parts[0].alias("name"), F.size(dna.ones_of(parts[1])).cast("long").alias("ones"))


def _fasta(spark: SparkSession, d: str) -> DataFrame:
    text = F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), LETTERS, "acgt" * 13), "[^acgt\n]", ">")
    joined = F.regexp_replace(dna.clean_fasta(text), "[^ACGT]+", "N")
    return table(spark, d, "documents").select(F.col("doc_id").alias("genome_id"), joined.alias("seq"))


def _csv(spark: SparkSession, d: str) -> DataFrame:
    line = F.when(F.col("ordinal") % 10 == 0, F.col("seq")).otherwise(F.concat_ws(",", F.col("ordinal").cast("string"), "seq"))
    rows = markers(spark, d).withColumn("line", line)
    return rows.select("ordinal", dna.after_comma(F.col("line")).alias("after_comma"), dna.second_field(F.col("line")).alias("second"), dna.last_field(F.col("line")).alias("last"))


def _case(spark: SparkSession, d: str) -> DataFrame:
    g = documents(spark, d).select(F.col("doc_id").alias("genome_id"), dna.normalise(F.translate(F.coalesce("text", F.lit("")), LETTERS, ("acgt" * 13))).alias("seq"))
    m = markers(spark, d).withColumn("seq", F.upper(F.lower("seq")))
    return matrix.fan_out(match(g, m), m)


def _one_hot(spark: SparkSession, d: str) -> DataFrame:
    return genomes(spark, d).select("genome_id", dna.one_hot(F.col("seq")).alias("rows")).select("genome_id", dna.from_one_hot(F.col("rows")).alias("seq"))


def _pack3(spark: SparkSession, d: str) -> DataFrame:
    packed = genomes(spark, d).select("genome_id", F.posexplode(dna.segments(F.col("seq"))).alias("at", "segment")).select("genome_id", "at", dna.pack3(F.col("segment")).alias("packed"))
    return packed.select("genome_id", F.col("at").cast("long").alias("at"), dna.unpack3(F.col("packed")).alias("segment"))


def _cell(spark: SparkSession, d: str) -> DataFrame:
    return matrix.cell(_bits(spark, d), 7, 3).select("genome_id", F.col("ordinal").cast("long").alias("ordinal"), F.col("present").cast("long").alias("present"))


def _column(spark: SparkSession, d: str) -> DataFrame:
    return matrix.marker_column(_bits(spark, d), 2).withColumn("present", F.col("present").cast("long"))


def _distinct(spark: SparkSession, d: str) -> DataFrame:
    return distinct_markers(markers(spark, d)).withColumn("length", F.col("length").cast("long"))


def _whole_pack(spark: SparkSession, d: str) -> DataFrame:
    packed = genomes(spark, d).select("genome_id", dna.pack_genome(F.col("seq")).alias("packed"))
    return packed.select("genome_id", dna.unpack_genome(F.col("packed")).alias("seq"))


def _packed_long(spark: SparkSession, d: str) -> DataFrame:
    """Long markers have ordinals of some millions, so many blocks."""
    return blocked.pack(_long_hits("auto")(spark, d))


def _blocked_column(spark: SparkSession, d: str) -> DataFrame:
    folder = stored.workspace(spark, "matrix")
    blocked.save(_packed_long(spark, d), folder)
    ids = table(spark, d, "documents").select(F.col("doc_id").alias("genome_id"))
    return blocked.column(blocked.load(spark, folder), ids, 3_200_010).withColumn("present", F.col("present").cast("long"))


def _blocked_xor(spark: SparkSession, d: str) -> DataFrame:
    once = _long_hits("auto")(spark, d).persist()  # three sides read it
    a, b = blocked.pack(once.where("ordinal % 2 = 0 OR ordinal % 3 = 0")), blocked.pack(once.where("ordinal % 3 = 0 OR ordinal % 5 = 0"))
    return blocked.ones(blocked.combine(a, b, "xor"))


def _split_scan(spark: SparkSession, d: str) -> DataFrame:
    """A FASTA file for each source, of all its documents, read in splits."""
    folder = stored.workspace(spark, "fasta")
    text = F.concat(F.lit(">doc "), F.col("doc_id").cast("string"), F.lit("\nN"), as_dna(F.col("text")), F.lit("N"))
    rows = documents(spark, d, "source").select(F.coalesce("source", F.lit("none")).alias("name"), text.alias("value"))
    rows.repartition("name").write.partitionBy("name").text(folder)
    m = markers(spark, d)
    name = F.url_decode(F.regexp_extract("path", "/name=([^/]*)/", 1))
    cut = lambda longest: pieces.read_pieces(spark, folder, longest).select(name.alias("genome_id"), "chunk_no", "chunk")
    return matrix.fan_out(match_pieces(cut, m).distinct(), m).withColumnRenamed("genome_id", "name")


def _marker_file(spark: SparkSession, d: str) -> DataFrame:
    folder = stored.workspace(spark, "markers")
    rows = markers(spark, d).orderBy("ordinal").coalesce(1)  # a marker file's lines have an order
    rows.select(F.concat_ws(",", F.col("ordinal").cast("string"), "seq").alias("value")).write.text(folder)
    return readers.read_markers(spark, folder, strict=True).select(*[F.col(c).cast("long").alias(c) for c in ("ordinal", "marker_id")], "seq")


def _result_file(spark: SparkSession, d: str) -> DataFrame:
    folder = stored.workspace(spark, "result")
    writers.write_result(_named(spark, d), folder)
    return readers.read_result(spark, folder)


def _incremental(spark: SparkSession, d: str) -> DataFrame:
    """Some genomes first, then all: only the rest is matched, and those that have changed."""
    folder, m = stored.workspace(spark, "store"), markers(spark, d)
    by_source = table(spark, d, "documents").groupBy(F.coalesce("source", F.lit("none")).alias("name")).agg(F.max("text").alias("text"))
    all_of = by_source.select(F.xxhash64("name").alias("genome_id"), "name", as_dna(F.col("text")).alias("seq"))
    stored.update(all_of.where("name < 'n'").withColumn("seq", F.reverse("seq")), m, folder)
    return stored.update(all_of, m, folder).select("name", "bits")


QUERIES = {
    "presence_bits": _bits,
    "presence_long": lambda s, d: _long(s, d).select("genome_id", F.col("ordinal").cast("long").alias("ordinal"), F.col("present").cast("long").alias("present")),
    "presence_hits": _hits("auto"),
    "presence_nested": _hits("nested"),
    "presence_seeded": _hits("seeded"),
    "presence_shuffled": _hits("shuffled"),
    "presence_by_length": _hits("by_length"),
    "presence_chunked": _hits("nested", stride=64),
    "long_markers": long_markers,
    **{f"long_{k}": _long_hits(k) for k in ("auto", "seeded", "sampled", "shuffled")},
    "already_clean": _clean,
    "manifest_prefix": _prefix,
    "segments_split_n": _segments,
    "collapse_n": _collapse,
    "marker_dedupe": _dedupe,
    "distinct_markers": _distinct,
    "duplicate_fanout": _fan_out,
    "marker_membership": _membership,
    "absent_pairs": _absent,
    "merge_presence": _merge,
    "bits_to_long": lambda s, d: QUERIES["presence_long"](s, d),
    "long_to_bits": _long_to_bits,
    "reconcile": _reconcile,
    "first_n_markers": lambda s, d: markers(s, d).where("ordinal < 10"),
    "first_n_genomes": lambda s, d: genomes(s, d).where("genome_id < 10"),
    "marker_stats": _marker_stats,
    "marker_prefixes": _prefixes,
    "genome_stats": _genome_stats,
    "genome_uniqueness": _uniqueness,
    "base_codes": _codes,
    "result_lines": _lines,
    "result_parse": _parsed,
    "fasta_clean": _fasta,
    "csv_field_rules": _csv,
    "case_insensitive_match": _case,
    "onehot_decode": _one_hot,
    "pack3_roundtrip": _pack3,
    "pack_whole_genome": _whole_pack,
    "matrix_cell": _cell,
    "matrix_column": _column,
    "blocked_column": _blocked_column,
    "blocked_xor_ones": _blocked_xor,
    "blocked_unpack": lambda s, d: blocked.unpack(_packed_long(s, d)),
    "fasta_split_scan": _split_scan,
    "marker_file": _marker_file,
    "result_file": _result_file,
    "incremental_store": _incremental,
}

_DNA = f"regexp_replace(translate(coalesce(text, ''), '{LETTERS}', '{BASES}'), '[^ACGT]+', 'N', 'g')"
_VIEWS = f"WITH g AS (SELECT doc_id AS genome_id, {_DNA} AS seq FROM documents), m AS (SELECT item_id AS ordinal, split_part({_DNA}, 'N', 2) AS seq FROM benchmark)"
_BARE = f"regexp_replace(translate(coalesce(text, ''), '{LETTERS}', '{BASES}'), '[^ACGT]+', '', 'g')"
_LONG_MARKERS = (
    f"SELECT item_id * 100000 + i AS ordinal, seq FROM (SELECT item_id, i, substr(bare, (i * width + 1)::BIGINT, width::BIGINT) AS seq, width FROM "
    f"(SELECT item_id, bare, width, unnest(range(0, (length(bare) // width + 1)::BIGINT)) AS i FROM (SELECT item_id, {_BARE} AS bare, item_id % 29 + 12 AS width FROM benchmark))) WHERE length(seq) = width"
)
_LONG_HITS = f"WITH g AS (SELECT doc_id AS genome_id, {_BARE} AS seq FROM documents), m AS ({_LONG_MARKERS}) SELECT genome_id, ordinal FROM g JOIN m ON contains(g.seq, m.seq)"
_FOUND = "m.seq <> '' AND contains(g.seq, m.seq)"
_HITS = f"{_VIEWS} SELECT genome_id, ordinal FROM g JOIN m ON {_FOUND}"
_LONG = f"{_VIEWS} SELECT genome_id, ordinal, CASE WHEN {_FOUND} THEN 1 ELSE 0 END::BIGINT AS present FROM g CROSS JOIN m"
_BITS = f"{_VIEWS} SELECT genome_id, string_agg(CASE WHEN {_FOUND} THEN '1' ELSE '0' END, '' ORDER BY ordinal) AS bits FROM g CROSS JOIN m GROUP BY genome_id"

ORACLE_SQL = {
    "presence_bits": _BITS,
    "presence_long": _LONG,
    **{k: _HITS for k in ("presence_hits", "presence_nested", "presence_seeded", "presence_shuffled", "presence_by_length", "presence_chunked")},
    "long_markers": _LONG_MARKERS,
    **{k: _LONG_HITS for k in ("long_auto", "long_seeded", "long_sampled", "long_shuffled")},
    "already_clean": "SELECT doc_id AS genome_id FROM documents WHERE NOT contains(coalesce(text, ''), chr(10))",
    "manifest_prefix": "SELECT CASE WHEN doc_id % 2 = 0 THEN 'g' ELSE 'other/g' END || doc_id AS path FROM documents",
    "segments_split_n": f"{_VIEWS} SELECT genome_id, segment FROM (SELECT genome_id, unnest(string_split(seq, 'N')) AS segment FROM g) WHERE segment <> ''",
    "collapse_n": f"{_VIEWS} SELECT genome_id, seq FROM g",
    "marker_dedupe": f"{_VIEWS} SELECT seq, min(ordinal) AS first_ordinal, count(*) AS n, string_agg(ordinal::VARCHAR, ',' ORDER BY ordinal) AS ordinals FROM m GROUP BY seq",
    "distinct_markers": f"{_VIEWS} SELECT DISTINCT seq, length(seq)::BIGINT AS length FROM m WHERE seq <> ''",
    "duplicate_fanout": f"{_VIEWS} SELECT f.first_ordinal, m.ordinal FROM (SELECT seq, min(ordinal) AS first_ordinal FROM m GROUP BY seq) f JOIN m ON f.seq = m.seq",
    "marker_membership": f"{_VIEWS} SELECT ordinal, seq FROM m WHERE EXISTS (SELECT 1 FROM g WHERE {_FOUND})",
    "absent_pairs": f"{_VIEWS} SELECT genome_id, ordinal FROM g CROSS JOIN m WHERE NOT ({_FOUND})",
    "merge_presence": f"SELECT genome_id, ordinal, CASE WHEN ordinal % 2 = 0 OR ordinal % 3 = 0 THEN present ELSE 0 END::BIGINT AS present FROM ({_LONG})",
    "bits_to_long": _LONG,
    "long_to_bits": _BITS,
    "reconcile": f"WITH a AS (SELECT 'g' || genome_id AS name, genome_id, bits FROM ({_BITS})), b AS (SELECT name, CASE WHEN bits LIKE '%1' THEN reverse(bits) ELSE bits END AS bits FROM a WHERE bits LIKE '1%') "
    "SELECT coalesce(a.name, b.name) AS name, a.bits AS a_bits, b.bits AS b_bits FROM a FULL OUTER JOIN b ON a.name = b.name WHERE a.bits IS DISTINCT FROM b.bits",
    "first_n_markers": f"{_VIEWS} SELECT ordinal, seq FROM m WHERE ordinal < 10",
    "first_n_genomes": f"{_VIEWS} SELECT genome_id, seq FROM g WHERE genome_id < 10",
    "marker_stats": f"{_VIEWS} SELECT count(*) AS n_markers, sum(length(seq))::BIGINT AS n_bases, (sum(length(seq)) + 24)::BIGINT AS size_sum, "
    "CASE WHEN count(*) > 1 THEN ceil(sum(length(seq)) - count(*) * (ln(count(*) / 2) / ln(4)) + 4) ELSE sum(length(seq)) + 24 END::BIGINT AS size_shared FROM m",
    "marker_prefixes": f"{_VIEWS} SELECT count(DISTINCT substr(seq, 1, i)) AS n_prefixes FROM (SELECT seq, unnest(range(1, length(seq) + 1)) AS i FROM m)",
    "genome_stats": f"{_VIEWS} SELECT count(*) AS n_genomes, max(length(seq)) AS longest, min(length(seq)) AS shortest, avg(length(seq)) AS mean_length FROM g",
    "genome_uniqueness": "SELECT source AS name, count(*) AS n FROM documents GROUP BY source HAVING count(*) > 1",
    "base_codes": f"{_VIEWS} SELECT genome_id, translate(seq, 'ACGT', '0123') AS codes FROM g",
    "result_lines": f"SELECT 'g' || genome_id || ' ' || bits AS value FROM ({_BITS})",
    "result_parse": f"SELECT 'g' || genome_id AS name, length(replace(bits, '0', ''))::BIGINT AS ones FROM ({_BITS})",
    "fasta_clean": f"SELECT doc_id AS genome_id, regexp_replace(upper(array_to_string(list_filter(string_split(regexp_replace(translate(coalesce(text, ''), '{LETTERS}', '{'acgt' * 13}'), '[^acgt\n]', '>', 'g'), chr(10)), lambda x: NOT starts_with(x, '>')), '')), '[^ACGT]+', 'N', 'g') AS seq FROM documents",
    "csv_field_rules": f"{_VIEWS} SELECT ordinal, seq AS after_comma, CASE WHEN ordinal % 10 = 0 THEN '' ELSE seq END AS second, seq AS last FROM m",
    "case_insensitive_match": _HITS,
    "onehot_decode": f"{_VIEWS} SELECT genome_id, seq FROM g",
    "pack3_roundtrip": f"{_VIEWS} SELECT genome_id, (row_number() OVER (PARTITION BY genome_id ORDER BY i) - 1)::BIGINT AS at, segment FROM (SELECT genome_id, unnest(string_split(seq, 'N')) AS segment, generate_subscripts(string_split(seq, 'N'), 1) AS i FROM g) WHERE segment <> ''",
    "matrix_cell": f"SELECT genome_id, ordinal, present FROM ({_LONG}) WHERE genome_id = 7 AND ordinal = 3",
    "matrix_column": f"SELECT genome_id, present FROM ({_LONG}) WHERE ordinal = 2",
    "pack_whole_genome": f"{_VIEWS} SELECT genome_id, seq FROM g",
    "blocked_column": f"SELECT doc_id AS genome_id, count(h.genome_id) AS present FROM documents LEFT JOIN (SELECT * FROM ({_LONG_HITS}) WHERE ordinal = 3200010) h ON h.genome_id = doc_id GROUP BY doc_id",
    "blocked_xor_ones": f"SELECT genome_id, count(*) AS ones FROM ({_LONG_HITS}) WHERE (ordinal % 2 = 0 OR ordinal % 3 = 0) <> (ordinal % 3 = 0 OR ordinal % 5 = 0) GROUP BY genome_id",
    "blocked_unpack": _LONG_HITS,
    "fasta_split_scan": f"SELECT DISTINCT coalesce(source, 'none') AS name, ordinal FROM ({_HITS}) h JOIN documents ON doc_id = genome_id",
    "marker_file": f"{_VIEWS} SELECT row_number() OVER (ORDER BY ordinal) - 1 AS ordinal, ordinal AS marker_id, seq FROM m",
    "result_file": f"SELECT 'g' || genome_id AS name, bits FROM ({_BITS})",
    "incremental_store": f"{_VIEWS}, s AS (SELECT coalesce(source, 'none') AS name, max(text) AS text FROM documents GROUP BY 1), t AS (SELECT name, {_DNA} AS seq FROM s) "
    "SELECT name, string_agg(CASE WHEN m.seq <> '' AND contains(t.seq, m.seq) THEN '1' ELSE '0' END, '' ORDER BY ordinal) AS bits FROM t CROSS JOIN m GROUP BY name",
}

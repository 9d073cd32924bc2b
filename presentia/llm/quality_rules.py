"""Operator 2: quality rules by distribution divergence. DataFrame functions only.

Each document has two histograms: its characters by class, and its words by the
commonest words of its language (one more bin holds all other words). Both are
compared by Jensen-Shannon distance with those of the language: the median share of
each character class and the mean share of each word over all its documents of
``min_words`` or more. A document that is
far from its language in either is rejected; one of too few words to judge is
rejected by the base rules already, and a histogram with fewer than
``min_chars`` characters isn't held against it.

Defined results: a null text has no words and fails; a null or unlisted language
is compared with all others of that kind, by characters alone; repeated rows
each get their own, equal, verdict; an empty table gives an empty result. Extra
columns are carried along; the operator's own columns replace any of their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presentia.llm.common import WORD, let, read_table

# Frequent function words of each language.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist ein nicht".split(),
    "en": "the of and to in a is that for it with as was on be by".split(),
    "es": "de la que el en y a los se del las un por con no una".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par".split(),
}
# Character classes after lower-case a to z and white space; a last bin has the rest.
CLASSES = ["[A-Z]+", r"[^\x00-\x7F]+", "[0-9]+", "[.,;:!?'\"()-]+"]
SYMBOLS = "[^#*$%&|<>]+"
SPACES = r"[\x20\x09-\x0D]+"
#: Windows of up to so many words have their number packed beside 49 bits of hash into one long.
PACK_BITS = 15
#: Shares of characters count in parts of so many.
GRAIN = 10_000


def words_of(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def repeated_positions(words: Column) -> Column:
    """Sorted first positions of the 3-word windows that occur twice or more."""
    last = F.size(words) - 3
    at = F.sequence(F.lit(0), last)
    key = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    mask = (1 << PACK_BITS) - 1
    packed = F.sort_array(F.transform(at, lambda i: F.shiftleft(key(i), PACK_BITS).bitwiseOR(i.cast("long"))))
    equal = lambda i, j: reduce(Column.__and__, [F.get(words, i + k) == F.get(words, j + k) for k in range(3)])
    at_of = lambda x: x.bitwiseAND(F.lit(mask)).cast("int")
    short = let(packed, lambda a: F.transform(_runs(a, lambda x: F.shiftright(x, PACK_BITS), at_of, equal), at_of))
    pairs = F.array_sort(F.transform(at, lambda i: F.struct(key(i).alias("h"), i.alias("i"))))
    long = let(pairs, lambda a: F.transform(_runs(a, lambda x: x["h"], lambda x: x["i"], equal), lambda x: x["i"]))
    none = F.array().cast("array<int>")
    return F.sort_array(F.when(last < 1, none).when(last < mask, short).otherwise(long))


def _runs(ordered: Column, key, at, equal) -> Column:
    """Of a sorted array, the elements whose key a neighbour shares, where what stands at both is ``equal`` as well."""

    def same(x: Column, i: Column, step: int) -> Column:
        other = F.get(ordered, i + step)
        return F.coalesce((key(other) == key(x)) & equal(at(other), at(x)), F.lit(False))

    return F.filter(ordered, lambda x, i: same(x, i, -1) | same(x, i, 1))


def jensen_shannon(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two arrays of counts or shares."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    xlog = lambda x: F.when(x > 0, x * F.log2(x)).otherwise(F.lit(0.0))
    share = lambda a: let(total(a), lambda n: F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))))
    # with x and y summing to 1, the divergence is 1 + sum(x log x + y log y - (x + y) log (x + y)) / 2
    each = F.zip_with(share(p), share(q), lambda x, y: xlog(x) + xlog(y) - xlog(x + y))
    return F.sqrt(F.greatest(F.lit(0.0), 1 + total(each) / 2))


def histograms(df: DataFrame, text: str, lang: str) -> DataFrame:
    """``df`` with _words, _lang, _len, _rest, _chars and _common: words, language, length, what is neither
    a lower-case letter nor white space, and the two histograms."""
    known = F.when(F.col(lang).isin(*COMMON_WORDS), F.col(lang)).otherwise(F.lit(""))
    body = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumns({"_words": words_of(F.col(text)), "_lang": known, "_len": F.length(body), "_dense": F.regexp_replace(body, "[a-z]+", "")})
    df = df.withColumns({"_rest": F.regexp_replace("_dense", SPACES, "")})
    of_class = [F.length("_rest") - F.length(F.regexp_replace("_rest", c, "")) for c in CLASSES]
    sums = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    chars = F.array(*[x.cast("double") for x in (F.col("_len") - F.length("_dense"), F.length("_dense") - F.length("_rest"), *of_class)])
    listed = F.element_at(F.create_map(*[x for k, v in COMMON_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), F.col("_lang"))
    every = sorted({x for v in COMMON_WORDS.values() for w in v for x in (w, w.capitalize(), w.upper())})
    kept = F.transform(F.filter("_words", lambda w: w.isin(every)), F.lower)
    own = let(kept, lambda ws: F.transform(F.coalesce(listed, F.array().cast("array<string>")), lambda c: (F.size(ws) - F.size(F.array_remove(ws, c))).cast("double")))
    with_rest = lambda a, n: let(a, lambda x: F.concat(x, F.array(F.greatest(F.lit(0.0), n.cast("double") - sums(x)))))
    df = df.withColumns({"_chars": with_rest(chars, F.col("_len")), "_common": with_rest(own, F.size("_words"))})
    return df.drop("_dense")


def language_references(docs: DataFrame, text: str = "text", lang: str = "lang", min_words: int = 50) -> DataFrame:
    """A row for each listed language and one for all others: the median share of every
    character class (which junk doesn't move) and the mean share of every word."""
    df = histograms(docs.select(text, lang), text, lang).where(F.size("_words") >= min_words)
    share = lambda a, n: F.transform(a, lambda x: x / n)
    df = df.select("_lang", share(F.col("_chars"), F.col("_len").cast("double")).alias("c"), share(F.col("_common"), F.size("_words").cast("double")).alias("w"))
    mean = lambda name, n: F.array(*[F.avg(F.get(F.col(name), F.lit(i))) for i in range(n)])
    means = df.groupBy("_lang").agg(mean("w", 1 + max(map(len, COMMON_WORDS.values()))).alias("_ref_common"))
    means = means.withColumn("_ref_common", F.filter("_ref_common", lambda x: x.isNotNull()))
    # shares in parts of GRAIN have at most GRAIN + 1 values, whose counts give the exact median of all
    parts = df.select("_lang", F.posexplode(F.transform("c", lambda x: F.round(x * GRAIN))).alias("i", "v")).groupBy("_lang", "i", "v").count()
    upto = Window.partitionBy("_lang", "i")
    parts = parts.withColumns({"_upto": F.sum("count").over(upto.orderBy("v")), "_all": F.sum("count").over(upto)}).where(2 * F.col("_upto") >= F.col("_all"))
    middle = parts.groupBy("_lang", "i").agg((F.min("v") / GRAIN).alias("v")).groupBy("_lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("_ref_chars"))
    return middle.join(means, "_lang")


def quality_rules(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    max_char_distance: float = 0.18,
    max_word_distance: float = 0.4,
    min_chars: int = 200,
) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance, kept."""
    out = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed char_distance word_distance kept".split()
    df = histograms(docs.drop(*out), text, lang)
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD))
    df = df.withColumns({"_lines": lines, "_at": repeated_positions(F.col("_words"))})
    following = lambda i: F.coalesce(F.get("_at", i + 1), F.lit(1 << 30))
    covered = F.aggregate(F.transform("_at", lambda x, i: F.least(F.lit(3), following(i) - x)), F.lit(0), lambda s, x: s + x)
    df = df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace("_rest", SYMBOLS, "")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": covered.cast("long"),
    })
    df = df.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))
    ref = language_references(docs, text, lang, min_words)
    df = df.join(F.broadcast(ref), "_lang", "left")  # a row for each listed language and one more
    guarded = lambda x: F.when(F.col("_len") >= min_chars, F.coalesce(x, F.lit(0.0))).otherwise(F.lit(0.0))
    df = df.withColumns({
        "char_distance": guarded(jensen_shannon(F.col("_chars"), F.col("_ref_chars"))),
        "word_distance": guarded(jensen_shannon(F.col("_common"), F.col("_ref_common"))),
    })
    far = (F.col("char_distance") > max_char_distance) | (F.col("word_distance") > max_word_distance)
    df = df.withColumn("kept", ~F.col("base_failed") & ~far)
    return df.drop("_lang", "_words", "_chars", "_common", "_len", "_rest", "_lines", "_at", "_ref_chars", "_ref_common")


def accepted(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their counts."""
    # A filter on the row number as well isn't pushed below the projections, which would write the verdict's whole expression out again and again.
    judged = quality_rules(docs, **how).withColumn("_row", F.monotonically_increasing_id())
    return judged.where(F.col("kept") & (F.col("_row") >= 0)).drop("_row")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: every document with its counts and verdict."""
    names = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()
    return quality_rules(read_table(spark, sf_dir, "documents")).select(*names)


def oracle_sql(max_char_distance: float = 0.18, max_word_distance: float = 0.4) -> str:
    """The same rows in DuckDB's SQL."""
    listed = " ".join(f"WHEN lang = '{k}' THEN [{', '.join(repr(w) for w in v)}]" for k, v in COMMON_WORDS.items())
    gone = lambda x, cls: f"regexp_replace({x}, '{cls}', '', 'g')"
    classes = ", ".join(f"(length(rest) - length({gone('rest', c.replace(chr(39), chr(39) * 2))}))::DOUBLE" for c in CLASSES)
    times = "(CASE WHEN {0} > 0 THEN {0} * log2({0}) ELSE 0 END)"
    term = " + ".join(times.format(f"x[{i}]") for i in (1, 2)) + " - " + times.format("(x[1] + x[2])")
    distance = lambda p, q: f"sqrt(greatest(0, 1 + list_sum(list_transform(list_zip({p}, {q}), lambda x: {term})) / 2))"
    share = lambda a: f"list_transform({a}, lambda v: v / nullif(list_sum({a}), 0))"
    far = " OR ".join(f"coalesce(CASE WHEN len >= 200 THEN {distance(share(h), share(f'q{h}'))} END, 0) > {most}" for h, most in (("ch", max_char_distance), ("wo", max_word_distance)))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({', '.join(repr(k) for k in COMMON_WORDS)}) THEN lang ELSE '' END AS lang FROM documents),
w AS (SELECT row_number() OVER () AS r, doc_id, t, lang, length(t) AS len, regexp_extract_all(t, '{WORD}') AS ws, {gone('t', '[a-z]+')} AS dense, CASE {listed} ELSE [] END AS common FROM d),
x AS (SELECT *, {gone('dense', SPACES)} AS rest, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{WORD}')) AS lines,
  list_transform(common, lambda c: len(list_filter(ws, lambda v: v = c OR v = upper(c) OR v = upper(c[1]) || c[2:]))::DOUBLE) AS own FROM w),
h AS (SELECT *, list_append(part, greatest(0, len - coalesce(list_sum(part), 0))) AS ch, list_append(own, greatest(0, len(ws) - coalesce(list_sum(own), 0))) AS wo
  FROM (SELECT *, [(len - length(dense))::DOUBLE, (length(dense) - length(rest))::DOUBLE, {classes}] AS part FROM x)),
refs AS (SELECT lang, list(c ORDER BY i) AS qch FROM (SELECT lang, i, quantile_disc(v, 0.5) AS c FROM (SELECT lang, round(unnest(ch) / len * {GRAIN}) / {GRAIN} AS v, generate_subscripts(ch, 1) AS i FROM h WHERE len(ws) >= 50) GROUP BY lang, i) GROUP BY lang),
refw AS (SELECT lang, list(c ORDER BY i) AS qwo FROM (SELECT lang, i, avg(v) AS c FROM (SELECT lang, unnest(wo) / len(ws) AS v, generate_subscripts(wo, 1) AS i FROM h WHERE len(ws) >= 50) GROUP BY lang, i) GROUP BY lang),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS n FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT r, sum(coalesce(least(3, following - i), 3))::BIGINT AS n_repeat_words FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS following FROM g WHERE n > 1) GROUP BY r),
b AS (SELECT h.*, qch, qwo, len(ws)::BIGINT AS n_words, coalesce(rep.n_repeat_words, 0) AS n_repeat_words FROM h LEFT JOIN refs USING (lang) LEFT JOIN refw USING (lang) LEFT JOIN rep USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length({gone('rest', SYMBOLS)})::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({far}) AS kept FROM f"""

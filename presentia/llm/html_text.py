"""Operator 8: main text of web pages as the maximum-scoring run of tokens.

A page becomes a sequence of tokens: words and tags. A word scores by the element
that it is in, with its class, and a tag by its name: in general a word is positive
and a tag negative, and weights learned from labelled pages (those whose author
marked the article) shift this: a tag or a place seen mostly inside articles scores
higher, one seen mostly outside scores far lower, be it listed below or not. One linear scan finds the run of tokens
with the largest sum. The text of the run, without what sits in elements that
are never content (menus, footers, asides, forms, scripts, notices, adverts,
comments by readers), is cut into blocks at block tags.

Weights are log ratios of smoothed counts from at most ``sample`` labelled pages,
chosen by a hash of the url; the counts are aggregated in Spark and the table has
the kinds of token of these pages, no more. With no labelled pages the prior weights stand.

Defined results: a null or empty html, or one without words, has an empty text;
repeated rows give equal texts; unclosed and unmatched tags are tolerated; an
empty table gives an empty result. Columns named text or n_chars are replaced.
"""

from __future__ import annotations

import hashlib
import html as references
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presentia.llm.common import read_table

MARK = re.compile(r"<(?:(!--|!\[CDATA\[|[!?])|(/?)([a-zA-Z][^\s/>]*))")
ENDS = {"!--": "-->", "![CDATA[": "]]>", "!": ">", "?": ">"}
QUOTED = re.compile(r"=\s*([\"'])")
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|style|aria-hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
# HTML's element kinds.
RAW = frozenset("script style noscript template textarea title iframe svg math select object canvas xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
PLACES = frozenset("nav header footer aside form article main menu dialog button figcaption table ul ol section div".split())
NEVER = frozenset("nav footer aside form menu dialog button head".split()) | RAW
# Words in class, id and role that name what is not content.
BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ads?|ad(?:box|slot|unit|wrap\w*|container|block)|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookie\w*|consent|gdpr|notice|alert|popup|modal|overlay|nav\w*|menu|breadcrumbs?|sidebar|widget|related|recommend\w*|"
    r"share|sharing|social|newsletter|subscribe|signup|login|comments?|commentlist|replies|responses?|respond|discussion|feedback|disqus|footer|masthead|pagination|pager|toolbar|search|copyright|legal|disclaimer)(?:$|[\s_-])",
    re.I,
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Prior scores: a word, a word of a link, a word of an element that is never content, one of these inside an article (which goes in any case), a tag.
WORD, LINK_WORD, NEVER_WORD, ASIDE, TAG = 1.0, -0.5, -1.0, -0.2, -0.6
COUNTS = T.StructType([T.StructField("token", T.StringType()), T.StructField("inside", T.LongType()), T.StructField("outside", T.LongType())])
RESULT = T.StringType()


def never_content(name: str, attributes: str) -> bool:
    """Whether an element is one that holds no part of an article."""
    if name in NEVER:
        return True
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    for key, value in ATTRIBUTE.findall(attributes):
        value = value.strip("\"'")
        key = key.lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if key == "role" and value.lower() in ROLES or key in ("class", "id") and BOILERPLATE.search(value):
            return True
    return False


def tag_end(page: str, at: int) -> int:
    """Where the tag ends whose attributes begin at ``at``; a ">" in a quoted value doesn't end it, unless the quote never closes."""
    first, end = at, page.find(">", at)
    while True:
        if 0 <= end < at:  # it was inside a quoted value
            end = page.find(">", at)
        quote = QUOTED.search(page, at, end if end >= 0 else len(page))
        close = page.find(quote[1], quote.end()) if quote else -1
        if close < 0:
            plain = end if end >= 0 else page.find(">", first)
            return plain + 1 if plain >= 0 else len(page)
        at = close + 1


def place_name(name: str, attributes: str) -> str:
    """An element's name with its class or else id, digits left out; a class of over 40 characters ends in a hash of it all."""
    given = {k.lower(): v.strip("\"'").lower() for k, v in ATTRIBUTE.findall(attributes)} if attributes else {}
    own = re.sub(r"\d+", "", given.get("class") or given.get("id") or "")
    own = own if len(own) <= 40 else f"{own[:40]}#{hashlib.md5(own.encode('utf-8', 'surrogatepass')).hexdigest()}"
    return f"{name}.{own}" if own else name


def tokens(page: str) -> Iterator[tuple[str, str, bool, bool]]:
    """(kind, text, bad, in_article) for each token in page order, in one pass.

    kind is "word/place" for a run of text and "tag/name" for a tag; ``bad`` says
    that it is inside an element that is never content. A <header> counts so
    unless it is inside an article.
    """
    stack: list[tuple[str, str, bool]] = []  # open elements: name, place, whether never content
    open_names: Counter = Counter()
    bad = articles = at = 0
    link = False

    def place() -> str:
        return "a" if link else stack[-1][1] if stack else "body"

    while m := MARK.search(page, at):
        if m.start() > at:
            yield "word/" + place(), page[at : m.start()], bad > 0, articles > 0
        if m[1]:  # a comment or declaration
            end = page.find(ENDS[m[1]], m.end())
            at = end + len(ENDS[m[1]]) if end >= 0 else len(page)
            continue
        at, name = tag_end(page, m.end()), m[3].lower()
        attributes = page[m.end() : at].rstrip(">")
        link = name == "a" and not m[2] or link and name in INLINE and name != "a"
        if m[2]:
            closed = bad > 0
            while open_names[name]:
                top, _, was_bad = stack.pop()
                open_names[top] -= 1
                bad -= was_bad
                articles -= top in ("article", "main")
                if top == name:
                    break
            yield "tag//" + name, "", closed, articles > 0
            continue
        is_bad = never_content(name, attributes) or name == "header" and not articles
        if name in RAW and not attributes.endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            yield "tag/" + name, "", True, articles > 0
            continue
        yield "tag/" + name, "", bad + is_bad > 0, articles > 0
        if name not in VOID and (name in PLACES or is_bad or name not in INLINE and "class" in attributes):
            stack.append((name, place_name(name, attributes), is_bad))
            open_names[name] += 1
            bad += is_bad
            articles += name in ("article", "main")
    if at < len(page):
        yield "word/" + place(), page[at:], bad > 0, articles > 0


def token_counts(pages: DataFrame, html: str) -> DataFrame:
    """For each kind of token, how often it is inside and outside the marked article of a labelled page."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for page in batch["page"]:
                for kind, text, bad, inside in tokens(page or ""):
                    n = len(text.split()) if kind.startswith("word/") else 1
                    pair = seen.setdefault(kind, [0, 0])
                    pair[0 if inside and not bad else 1] += n
            yield pd.DataFrame([(k, a, b) for k, (a, b) in seen.items()], columns=COUNTS.names)

    each = pages.select(F.col(html).alias("page")).mapInPandas(count, COUNTS)
    return each.groupBy("token").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))


def learn_weights(pages: DataFrame, url: str, html: str, sample: int = 2000, strength: float = 50.0) -> dict[str, float]:
    """Scores by kind of token: the prior, moved by the log ratio of its shares inside and outside articles.

    Labelled pages have an <article> or <main>; those with the ``sample`` smallest hashes of the url are used.
    """
    labelled = pages.where(F.col(html).rlike("(?i)<(article|main)[\\s>]")).select(F.col(html), F.xxhash64(url).alias("_order"))
    last = labelled.select("_order").orderBy("_order").limit(sample).agg(F.max("_order")).first()[0]
    chosen = labelled.where(F.col("_order") <= F.lit(last))  # stays where it is: only hashes are sorted
    rows = token_counts(chosen, html).collect()  # kinds of at most `sample` pages
    inside, outside = sum(r.inside for r in rows) + 1, sum(r.outside for r in rows) + 1
    weights = {}
    for r in rows:
        prior = prior_score(r.token)
        ratio = math.log((r.inside + 0.5) / inside) - math.log((r.outside + 0.5) / outside)
        trust = (r.inside + r.outside) / (r.inside + r.outside + strength)
        weights[r.token] = prior + trust * max(-4.0, min(2.0, ratio))
    return weights


def prior_score(kind: str) -> float:
    if not kind.startswith("word/"):
        return TAG
    return LINK_WORD if kind == "word/a" else NEVER_WORD if kind[5:].partition(".")[0] in NEVER else WORD


def score(kind: str, weights: dict[str, float]) -> float:
    """The weight of a kind of token; of a place with a class that isn't known, that of the element."""
    plain = kind.partition(".")[0]
    return weights.get(kind, weights.get(plain, prior_score(plain)))


def best_run(scores: list[float]) -> tuple[int, int]:
    """The run [first, last) with the largest sum; (0, 0) if no score is positive. Of ties, the longest."""
    best, best_run, total, first = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(scores):
        if total < 0:
            total, first = 0.0, i
        total += x
        if total > best or total == best and best > 0:
            best, best_run = total, (first, i + 1)
    return best_run


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """The text of a page's best run."""
    seen = list(tokens(page or ""))
    scores = []
    for kind, text, bad, inside in seen:
        n = len(text.split()) if kind.startswith("word/") else 1
        scores.append(n * (ASIDE if bad and inside else min(ASIDE, score(kind, weights)) if bad else score(kind, weights)))
    first, last = best_run(scores)
    blocks, block = [], []
    for kind, text, bad, _ in seen[first:last]:
        if kind.startswith("tag/"):
            name = kind.rpartition("/")[2]
            if name not in INLINE:
                blocks.append("".join(block))
                block = []
        elif not bad:
            block.append(text)
    blocks.append("".join(block))
    clean = (" ".join(references.unescape(b).split()) for b in blocks)
    return " ".join(b for b in clean if b)


def extract_text(pages: DataFrame, url: str = "url", html: str = "html", weights: dict[str, float] | None = None, sample: int = 2000) -> DataFrame:
    """``pages`` with text and n_chars; weights are learned from the pages themselves unless given."""
    weights = learn_weights(pages, url, html, sample) if weights is None else weights

    @F.pandas_udf(RESULT)
    def extract(batch: pd.Series) -> pd.Series:
        return pd.Series([main_text(x, weights) for x in batch], dtype=object)

    out = pages.drop("text", "n_chars").withColumn("text", extract(html))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: every page's main text."""
    return extract_text(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")

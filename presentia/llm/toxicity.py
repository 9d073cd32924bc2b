"""Operator 9: toxicity by a weighted lexicon matched with an Aho-Corasick automaton.

Texts are folded first: case, look-alike letters of other scripts, and digits and
signs that stand for letters inside words; all other marks part words. The
lexicon has whole words and word beginnings, with weights: the lower bound of
their log odds between toxic and other documents, numbers of documents with a term
smoothed by 0.5 and those without by 1. Where several match one word,
the heaviest counts. A phrase of two words, one of them in the lexicon, that
occurs at least as readily in other documents is an exception and hides its
match; ``exceptions`` adds phrases. The sum of weights, as such and normalised by
length, goes through a logistic function fitted on labelled documents that the
lexicon wasn't learned from.

Labels are learned from at most ``sample`` rows, chosen by a hash of the id. Only
texts are inputs of a score.

Defined results: a null, empty or blank text gets the score of a text without
matches; ids without a label are scored like any other; of rows that label an id
twice, the larger label holds; of several texts of an id the smallest is learned
from, and all are scored; with no labelled row every score is 0; an empty
table gives an empty result. Columns named held_out, score, predicted are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presentia.llm.common import read_table

# Letters that look like Latin ones, and digits and signs written for letters.
LOOK_ALIKES = dict(zip("авекмнорстухіјѕԁһӏɡոսαβεικνορτυχωı", "abekmhopctyxijsdhlgnuabeiknoptuxwi", strict=True))
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "l", "+": "t", "€": "e"}
# Harmless phrases.
EXCEPTIONS = ("circus clown", "clown fish", "guinea pig", "killer whale", "trash can")
FOLD = str.maketrans(LOOK_ALIKES | DIGITS)
SIGN = str.maketrans(SIGNS)
OUTER = re.compile(r"[^\w\s]+(?!\w)|(?<!\w)[^\w\s]+")
INNER = re.compile(r"[^\w\s]+|_+")
PREFIXES = range(4, 9)
COUNTS = T.StructType([T.StructField("term", T.StringType()), T.StructField("toxic", T.LongType()), T.StructField("other", T.LongType())])
FEATURES = T.StructType([T.StructField("weight", T.DoubleType()), T.StructField("words", T.LongType())])


def fold(text: str | None) -> str:
    """Folded words with one space before and after each."""
    folded = OUTER.sub(" ", (text or "").casefold().translate(FOLD)).translate(SIGN)
    return " " + " ".join(INNER.sub(" ", folded).split()) + " "


def terms_of(folded: str) -> set[str]:
    """Candidate terms of a text: " word " and " beginning"."""
    words = set(folded.split())
    return {f" {w} " for w in words if len(w) > 2} | {" " + w[:n] for w in words for n in PREFIXES if len(w) > n}


class Lexicon:
    """An automaton over weighted terms and exception phrases."""

    def __init__(self, terms: dict[str, float], phrases: tuple[str, ...]):
        self.automaton = ahocorasick.Automaton()
        for term, weight in terms.items():
            self.automaton.add_word(term, (len(term), weight))
        for phrase in phrases:
            self.automaton.add_word(f" {phrase} ", (len(phrase) + 2, None))
        if terms or phrases:
            self.automaton.make_automaton()

    def matches(self, folded: str) -> dict[int, float]:
        """Weight by the start of each matched word, without what an exception covers."""
        if not len(self.automaton):
            return {}
        found: dict[int, float] = {}
        hidden: set[int] = set()
        for end, (n, weight) in self.automaton.iter(folded):
            start = end - n + 1
            if weight is None:
                hidden.update(i for i in range(start, end) if folded[i] == " ")
            elif weight > found.get(start, 0.0):
                found[start] = weight
        return {k: v for k, v in found.items() if k not in hidden}


@lru_cache(maxsize=4)
def lexicon(terms: tuple, phrases: tuple) -> Lexicon:
    return Lexicon(dict(terms), phrases)


def _counted(docs: DataFrame, candidates) -> DataFrame:
    """Toxic and other documents with each candidate that ``candidates(text)`` gives."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                for term in candidates(fold(text)):
                    seen.setdefault(term, [0, 0])[0 if toxic else 1] += 1
            yield pd.DataFrame([(k, a, b) for k, (a, b) in seen.items()], columns=COUNTS.names)

    return docs.mapInPandas(count, COUNTS).groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def learn_lexicon(docs: DataFrame, least: int = 3, size: int = 5000, exceptions: tuple[str, ...] = EXCEPTIONS) -> tuple[tuple, tuple]:
    """(terms with weights, exception phrases) from documents (text, toxic)."""
    totals = docs.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    toxic, other = totals.t or 0, (totals.n or 0) - (totals.t or 0)
    if not toxic or not other:
        return (), tuple(exceptions)
    a, b = F.col("toxic") + 0.5, F.col("other") + 0.5
    odds = F.log(a / (toxic + 1 - a + 0.5)) - F.log(b / (other + 1 - b + 0.5))
    bound = odds - 1.64 * F.sqrt(1 / a + 1 / b)
    rows = _counted(docs, terms_of).where(F.col("toxic") >= least).withColumn("weight", bound).where("weight > 1").orderBy(F.desc("weight"), "term").limit(size)
    terms = {r.term: float(r.weight) for r in rows.collect()}  # at most `size`

    def phrases_of(folded: str) -> set[str]:
        words, known = folded.split(), lexicon(tuple(sorted(terms.items())), ()).matches(folded)
        at, out = 0, set()
        for i, w in enumerate(words):
            if at in known:
                out |= {" ".join(words[max(0, i - 1) : i + 1])} | {" ".join(words[i : i + 2])}
            at += len(w) + 1
        return {x for x in out if " " in x}

    phrases = _counted(docs, phrases_of).where((F.col("other") >= least) & (F.col("other") / other >= F.col("toxic") / toxic)).orderBy(F.desc("other"), "term").limit(size)
    return tuple(sorted(terms.items())), tuple(sorted({*exceptions, *(r.term for r in phrases.collect())}))  # at most `size`


def features(terms: tuple, phrases: tuple):
    """A column function: the sum of matched weights and the number of words of a text."""

    @F.pandas_udf(FEATURES)
    def of(texts: pd.Series) -> pd.DataFrame:
        known, rows = lexicon(terms, phrases), []
        for text in texts:
            folded = fold(text)
            rows.append((math.fsum(known.matches(folded).values()), folded.count(" ") - 1 if len(folded) > 2 else 0))
        return pd.DataFrame(rows, columns=FEATURES.names)

    return of


def design(weight: Column, words: Column) -> list[Column]:
    """Inputs of the logistic function: the weight, and the weight for the length."""
    return [F.log1p(weight), F.log1p(1000 * weight / (words + 50))]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> list[float]:
    """Logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta)), x.T @ (y - p) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return [float(b) for b in beta]


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = 20_000):
    """(terms, phrases, coefficients) from at most ``sample`` labelled rows that aren't held out."""
    chosen = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id))).groupBy(doc_id).agg(F.max(label).alias("toxic"))
    chosen = chosen.withColumn("_order", F.xxhash64(F.lit(9), doc_id)).orderBy("_order").limit(sample)
    rows = docs.select(doc_id, F.col(text).alias("text")).join(F.broadcast(chosen), doc_id).groupBy("_order", "toxic", doc_id).agg(F.min("text").alias("text"))  # at most `sample` rows
    rows = rows.select("text", F.col("toxic").cast("int").alias("toxic"), F.pmod("_order", F.lit(10)).alias("_part"))
    terms, phrases = learn_lexicon(rows.where("_part < 6").select("text", "toxic"))
    rest = rows.where("_part >= 6").withColumn("f", features(terms, phrases)("text")).select("toxic", *design(F.col("f.weight"), F.col("f.words")))
    got = np.array([list(r) for r in rest.collect()], dtype=float)  # at most `sample` rows of three numbers
    if not len(got):
        return terms, phrases, None
    return terms, phrases, fit(got[:, 1:], got[:, 0])


def score_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = 20_000) -> DataFrame:
    """``docs`` with held_out, score (0 to 1) and predicted (1 from 0.5 on)."""
    terms, phrases, beta = learn(docs, labels, doc_id, text, label, sample)
    out = docs.drop("held_out", "score", "predicted").withColumn("_f", features(terms, phrases)(F.col(text)))
    z = F.lit(-700.0)
    if beta:
        z = F.lit(beta[0])
        for b, x in zip(beta[1:], design(F.col("_f.weight"), F.col("_f.words")), strict=True):
            z = z + b * x
    out = out.withColumns({"held_out": held_out(F.col(doc_id)), "score": 1 / (1 + F.exp(-z))})
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).drop("_f")


def query(spark, sf_dir: str) -> DataFrame:
    """op9: every document's toxicity."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return score_toxicity(docs.select("doc_id", "text"), labels).select("doc_id", "held_out", "score", "predicted")

"""The pipeline's stages against brute-force versions of each, on its own input."""

import base64
import collections
import hashlib
import random
import re

import numpy as np
import pytest
import tiktoken

import corpus_pipeline as pipeline
from presentia.llm import bpe, quality_rules
from tests.llm.test_operators import lines_by_brute_force

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(21)
    common = quality_rules.COMMON_WORDS["en"]
    word = lambda: rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 9)))
    line = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    text = lambda: "\n".join(line(rng.randint(12, 60)) for _ in range(rng.randint(3, 8)))
    good = [text() for _ in range(70)]
    passage = line(60)
    good += [f"{line(60)}\n{passage}\n{line(30)}" for _ in range(4)]
    single = [line(150) for _ in range(8)]
    near = [re.sub(r"^\S+", "Changed", t) for t in single[:5]]
    junk = [" | ".join(WORDS.findall(good[0])), good[1].upper().replace(" ", "!! "), line(5), None, "", "same words again " * 60]
    rows = [*good, *single, *near, *good[:6], *junk]
    data = [(i, t, "en", rng.choice(["a", "b", "c", None]), None) for i, t in enumerate(rows)]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(data, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    outputs, docs = [], spark.read.parquet(f"{folder}/documents.parquet")
    for i, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        outputs.append(docs.collect())
    return folder, data, outputs


def test_columns(spark, tables):
    folder, _, _ = tables
    for i in range(4):
        assert spark.read.parquet(f"{folder}/{i}").columns == pipeline.COLUMNS


def test_quality_stage(tables):
    _, data, (rows, *_) = tables
    texts = {d: t or "" for d, t, *_ in data}
    words = {d: WORDS.findall(t) for d, t in texts.items()}

    def shares(t, w):
        count = lambda c: sum(map(len, re.findall(c, t)))
        chars = [count("[a-z]+"), count(r"[\x20\x09-\x0D]+"), *(count(c) for c in quality_rules.CLASSES)]
        own = [sum(x in (c, c.upper(), c.capitalize()) for x in w) for c in quality_rules.COMMON_WORDS["en"]]
        return [np.array([*v, n - sum(v)]) / max(1, n) for v, n in ((chars, len(t)), (own, len(w)))]

    def distance(p, q):
        p, q = p / p.sum(), q / q.sum()
        m = (p + q) / 2
        kl = lambda x: sum(a * np.log2(a / b) for a, b in zip(x, m, strict=True) if a)
        return np.sqrt(max(0, (kl(p) + kl(q)) / 2))

    each = {d: shares(texts[d], words[d]) for d in texts}
    long = [d for d in texts if len(words[d]) >= 50]
    median = np.sort(np.array([each[d][0] for d in long]), axis=0)[(len(long) - 1) // 2]
    mean = np.mean([each[d][1] for d in long], axis=0)
    kept = set()
    for d in long:
        grams = list(zip(words[d], words[d][1:], words[d][2:], strict=False))
        n = collections.Counter(grams)
        covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in (i, i + 1, i + 2)}
        if 100 * len(covered) <= 50 * len(words[d]) and distance(each[d][0], median) <= 0.18 and distance(each[d][1], mean) <= 0.4:
            kept.add(d)
    assert {r.doc_id for r in rows} == kept and len(kept) >= 90
    assert all(r.text == texts[r.doc_id] and r.n_chars == len(r.text) for r in rows)


def test_line_stage(tables):
    _, _, (before, rows, *_) = tables
    before = sorted(before)
    expected = {}
    for r, gone in zip(before, lines_by_brute_force([r.text for r in before]), strict=True):
        left = "\n".join(x for i, x in enumerate(r.text.split("\n")) if i not in gone)
        if left.strip():
            expected[r.doc_id] = left
    assert {r.doc_id: r.text for r in rows} == expected and len(expected) < len(before)


def test_near_duplicate_stage(tables):
    _, _, (_, before, rows, *_) = tables
    words = {r.doc_id: re.sub("[A-Z]", lambda m: m[0].lower(), r.text).split() for r in before}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in words.items()}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {r.doc_id for r in rows} == {d for d in sets if find(d) == d} and len(rows) < len(before)


def test_mixing_stage(tables):
    _, _, (_, _, before, rows, _) = tables
    size = {r.doc_id: len(r.text.split()) for r in before}
    sizes, taken, copies = collections.Counter(), collections.Counter(), collections.Counter(r.doc_id for r in rows)
    for r in before:
        sizes[r.source] += size[r.doc_id]
        taken[r.source] += size[r.doc_id] * copies[r.doc_id]
    assert set(copies.values()) <= {1, 2} and set(copies) <= set(size)
    order = [*sorted(s for s in sizes if s is not None), None]
    weight, capped, total = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, set(), 1.5 * sum(sizes.values())
    while True:
        level = (total - sum(2 * sizes[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        over = {s for s in order if s not in capped and level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        capped |= over
    for s in order:
        assert abs(taken[s] - (2 * sizes[s] if s in capped else level * weight[s])) <= 0.05 * taken[s] + 30


def test_token_stage(tables):
    import public_tokenizers as p

    _, _, (*_, before, rows) = tables
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(p.path(bpe.VOCABULARY), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = collections.Counter()
    for r in before:
        ids = np.array(encoding.encode_ordinary(r.text), "<u4")
        expected[r.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == expected


def test_run(spark, tables):
    folder, _, (*_, rows) = tables
    assert sorted(pipeline.run(spark, folder).collect()) == sorted(rows)


@pytest.fixture(scope="module")
def shared_ids(spark, tmp_path_factory):
    """Documents that share an id, or have none, and whose texts differ; some are exact or near copies."""
    rng = random.Random(33)
    common = quality_rules.COMMON_WORDS["en"]
    word = lambda: rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 9)))
    line = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    lone = [line(60) for _ in range(40)]  # one size, no id, one source
    twins = [f"{line(40)}\n{line(40)}" for _ in range(12)]
    passage = line(50)
    rows = [(None, t, "en", "a", None) for t in lone]
    rows += [(i // 4, t, "en", "b", None) for i, t in enumerate(twins)]
    rows += [(2, f"{passage}\n{line(60)}", "en", "b", None), (2, f"{line(60)}\n{passage}", "en", "b", None), (9, f"{passage}\n{line(70)}", "en", None, None)]
    rows += [(1, re.sub(r"^\S+", "Changed", twins[0]), "en", "b", None), (1, twins[4], "en", "b", None)]
    folder = str(tmp_path_factory.mktemp("shared"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return folder, rows, passage


def test_rows_that_share_an_id_stay_apart(spark, shared_ids):
    folder, rows, passage = shared_ids
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    unit = lambda r: (r[0] is not None, r[0] or 0, r[1])
    # lines: only the passage and whole or near copies of lines go, each but once, and from no other row
    out = pipeline.delete_repeated_lines(spark, docs, folder)
    texts = collections.Counter(r.text for r in out.collect())
    joined = "\n".join(texts)  # rows equal in id and text are one
    lines = {x for _, t, *_ in rows for x in t.split("\n")}
    held = collections.Counter(x for i, t in {(i, t) for i, t, *_ in rows if i is not None} for x in t.split("\n"))
    assert all(joined.count(x) == 1 for x in lines if held[x]) and joined.count(passage) == 1
    assert sum(t in {x[1] for x in rows if x[0] is None} for t in texts.elements()) == 40
    # near duplicates: one row of each group, none else
    out = pipeline.keep_one_of_near_duplicates(spark, docs, folder).collect()
    named = [r for r in rows if r[0] is not None]
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), t).split() for _, t, *_ in named]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in words]
    groups = []
    for k, s in enumerate(sets):
        meet = [g for g in groups if any(len(s & sets[x]) >= 0.8 * len(s | sets[x]) for x in g)]
        groups = [g for g in groups if g not in meet] + [[x for g in meet for x in g] + [k]]
    kept = sorted(unit(r) for r in out if r.doc_id is not None)
    assert sum(r.doc_id is None for r in out) == 40
    choices = [{unit(named[x]) for x in g} for g in groups]
    assert all(len({*kept} & c) == 1 for c in choices) and len({*kept}) == len(choices)
    assert all(min(x[1] for x in c) == next(x[1] for x in kept if x in c) for c in choices)
    # mixing: no text more than twice for each of its rows, sources near their targets
    out = pipeline.mix_to_weights(spark, docs, folder).collect()
    given, taken = collections.Counter(unit(r) for r in rows), collections.Counter(unit(r) for r in out)
    assert set(taken) <= set(given) and all(n <= 2 * given[x] for x, n in taken.items()) and len({t for *_, t in taken}) > 30


def test_run_over_shared_ids(spark, shared_ids):
    folder, rows, _ = shared_ids
    assert 0 < pipeline.run(spark, folder).count() <= 2 * len(rows)

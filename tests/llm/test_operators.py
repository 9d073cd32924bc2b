"""The corpus operators against brute-force versions, exact round trips and held-out labels on small tables."""

import base64
import collections
import hashlib
import math
import random
import re
import time
import types
import zlib

import numpy as np
import pandas as pd
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from presentia.llm import bpe, html_text, kneser_ney, line_dedup, mixing, order_minhash, pitman_yor, quality_rules, simhash, toxicity

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"
ODD = [None, "", " ", "\n\n", "word", "A b\tC\x0bd\re", "x" * 3000, "naïve café ÉCOLE ß İ", "é́ 日本 😀", "'s 're don't DON'T  \n 12ab!?"]


def documents(spark, texts, langs="en", sources="s", first=0):
    pick = lambda x, i: x[i % len(x)] if isinstance(x, list) else x
    rows = [(first + i, t, pick(langs, i), pick(sources, i), None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{int(rng.paretovariate(0.6)) % vocabulary}x" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    base = [prose(rng, rng.randint(1, 150)) for _ in range(60)]
    near = []
    for t in base[:25]:
        w = t.split()
        w[rng.randrange(len(w))] = "edited"
        near.append(" ".join(w))
    return ODD + base + base[:10] + near


def lowered(text):
    return WORDS.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


# 1 SimHash


def test_golay_keys_meet_within_two_bits():
    leaders = simhash.golay_tables()[2][:, 0]
    errors = [0] + [1 << i for i in range(23)] + [1 << i | 1 << j for i in range(23) for j in range(i)]
    own = simhash.codeword_indices(leaders)
    for e in errors:  # by linearity this is every pair of words
        other = simhash.codeword_indices(leaders ^ e)
        assert ((own[:, :, None] == other[:, None, :]) & (own[:, :, None] >= 0)).any(axis=(1, 2)).all()


def brute_fingerprint(text):
    w = lowered(text)
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    ones = [sum(xxhash.xxh64_intdigest(x, 42) >> b & 1 for x in s) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(s))


def test_simhash_components(spark, texts):
    rows = simhash.near_duplicates(documents(spark, texts, first=5).select("doc_id", "text", F.lit(1).alias("fp"))).collect()
    fps = {r.doc_id: brute_fingerprint(texts[r.doc_id - 5]) for r in rows}
    assert all(r._fp % 2**64 == fps[r.doc_id] for r in rows)
    root = {d: d for d in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 2:
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert {r.doc_id: r.component_id for r in rows} == {d: find(d) for d in fps}


def test_crowded_keys_lose_no_link(spark):
    rng = random.Random(2)
    center = rng.getrandbits(64)
    values = {center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(400)} | {rng.getrandbits(64) for _ in range(50)}
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    nodes = spark.createDataFrame([(v,) for v in signed], "fp LONG")
    got = {r.node: r.root for r in simhash.components(simhash.links(nodes, few=4)).collect()}
    arr = np.array(signed, dtype=np.int64)
    root = {v: v for v in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for v in signed:
        for o in arr[np.bitwise_count((arr ^ np.int64(v)).view(np.uint64)) <= 2]:
            a, b = sorted((find(v), find(int(o))))
            root[b] = a
    assert all(got.get(v, v) == find(v) for v in signed)


def test_long_chain_of_links(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 201)], "a LONG, b LONG")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 101)}, 201: 200}


def test_deduplicate_five_word_shingles(spark):
    rng = random.Random(4)
    base = [" ".join(f"{rng.getrandbits(40):010x}" for _ in range(120)) for _ in range(40)]
    near = [" ".join(["changed", *t.split()[1:]]) for t in base[:30]]
    far = [" ".join("other" if i % 4 == 0 else w for i, w in enumerate(t.split())) for t in base[:10]]
    docs = documents(spark, base + near + base[:5] + far + ["", None, "one", "one"])
    kept = {r.doc_id for r in simhash.deduplicate(docs).collect()}
    assert kept == {*range(40), *range(75, 85), 85, 87}
    many = [" ".join([*base[0].split()[:i], f"edit{i}", *base[0].split()[i + 1 :]]) for i in range(60)]
    assert [r.doc_id for r in simhash.deduplicate(documents(spark, [base[0], *many])).collect()] == [0]


def kept_by_brute_force(texts):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in map(lowered, texts)]
    root = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if root[a] != root[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    return {i for i, r in enumerate(root) if i == r}


def test_deduplicate_stars_and_chains(spark):
    rng = random.Random(6)
    word = lambda: f"{rng.getrandbits(40):010x}"
    rows = []
    for _ in range(3):  # an original in the middle; its copies are alike to it and not to each other
        base = [word() for _ in range(300)]
        star = []
        for _ in range(40):
            copy = list(base)
            for i in rng.sample(range(0, 300, 6), 6):
                copy[i] = word()
            star.append(" ".join(copy))
        rows += [*star[:20], " ".join(base), *star[20:]]
    chain = [word() for _ in range(300)]  # each is alike to its neighbours only
    for k in range(40):
        rows.append(" ".join(chain))
        chain[(k * 30) % 300 : (k * 30) % 300 + 25] = [word() for _ in range(25)]
    shared = [word() for _ in range(30)]  # many that share a passage and nothing else
    rows += [" ".join([*shared, *(word() for _ in range(20))]) for _ in range(60)]
    rng.shuffle(rows)
    assert {r.doc_id for r in simhash.deduplicate(documents(spark, rows)).collect()} == kept_by_brute_force(rows)


def test_deduplicate_contiguous_edits(spark):
    rng = random.Random(5)
    words = lambda n: [f"{rng.getrandbits(40):010x}" for _ in range(n)]
    base = [words(300) for _ in range(200)]
    edited = [[*b, *words(73)] if i % 2 else [*b[: 134 * (i % 4)], *words(32), *b[134 * (i % 4) + 32 :]] for i, b in enumerate(base)]  # similarity 0.80
    few = [f"{'a b ' * rng.randint(1, 9)}{' '.join(rng.choice(['one', 'two', 'six', 'longer']) for _ in range(60))}" for _ in range(40)]  # few different words
    few += [" ".join([*t.split()[:-4], "quite", "other"]) for t in few]
    texts = [" ".join(x) for x in base + edited]
    assert {r.doc_id for r in simhash.deduplicate(documents(spark, texts)).collect()} == set(range(200))
    assert {r.doc_id for r in simhash.deduplicate(documents(spark, few)).collect()} == kept_by_brute_force(few)


# 2 quality rules


def test_quality_counts(spark, texts):
    more = [*texts, "a b c a b c a b c", "x y\nx y\n \nx y", "Oure " * 90, "p q r s " * 40000]
    rows = quality_rules.quality_rules(documents(spark, more, ["en", None, "xx"]).withColumn("kept", F.lit(5))).collect()
    for r in rows:
        t = more[r.doc_id] or ""
        w = WORDS.findall(t)
        grams = list(zip(w, w[1:], w[2:], strict=False))
        n = collections.Counter(grams)
        covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r.base_failed and r.kept)


def test_quality_verdicts(spark):
    rng = random.Random(1)
    common = quality_rules.COMMON_WORDS["en"]
    good = [" ".join(rng.choice(common) if rng.random() < 0.4 else prose(rng, 1).strip("0123456789") + "er" for _ in range(120)) for _ in range(40)]
    bad = [" | ".join(f"w{rng.getrandbits(30)}" for _ in range(100)), good[0].upper().replace(" ", "!! "), " ".join(w + "%%%" for w in good[1].split())]
    rows = quality_rules.quality_rules(documents(spark, good + bad)).orderBy("doc_id").collect()
    assert [r.kept for r in rows] == [True] * 40 + [False] * 3
    assert quality_rules.accepted(documents(spark, good + bad)).count() == 40


def test_jensen_shannon(spark):
    p, q = [3.0, 1.0, 0.0], [0.0, 1.0, 1.0]
    a, b = np.array(p) / 4, np.array(q) / 2
    m = (a + b) / 2
    kl = lambda x: sum(u * math.log2(u / v) for u, v in zip(x, m, strict=True) if u)
    got = spark.range(1).select(quality_rules.jensen_shannon(F.lit(p), F.lit(q)).alias("d")).first().d
    assert got == pytest.approx(math.sqrt((kl(a) + kl(b)) / 2))


# 3 mixing


@pytest.mark.parametrize("cell", [8, 256])
def test_mix_meets_targets(spark, cell):
    rng = random.Random(6)
    texts = [None, "", *(prose(rng, min(2000, int(rng.paretovariate(0.8) * 10))) for _ in range(400))]
    sources = ["a" if rng.random() < 0.4 else rng.choice(["b", "c", "Z", None]) for _ in texts]
    docs = documents(spark, texts, "en", sources)
    rows = mixing.mix_sources(docs, cell=cell).collect()
    again = mixing.mix_sources(docs.repartition(7), cell=cell).collect()
    assert {(r.doc_id, r.taken) for r in rows} == {(r.doc_id, r.taken) for r in again} and len(rows) == len(texts)
    sizes = collections.Counter()
    for t, s in zip(texts, sources, strict=True):
        sizes[s] += len(WORDS.findall(t or ""))
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight, total, capped = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()), set()
    while True:
        level = (total - sum(2 * sizes[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        over = {s for s in order if s not in capped and level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        capped |= over
    target = {s: 2 * sizes[s] if s in capped else level * weight[s] for s in order}
    taken = collections.Counter()
    for r in rows:
        assert r.size == len(WORDS.findall(texts[r.doc_id] or "")) and r.taken == r.copies * r.size <= 2 * r.size and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source])
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 20 for s in order)
    repeated = mixing.repeat_documents(docs, cell=cell)
    assert repeated.columns == docs.columns and repeated.count() == sum(r.copies for r in rows)


def test_balanced_rates_and_repeated_rows(spark):
    """The multipliers against bisection; rows of one id, or none, in many copies."""
    rng = random.Random(16)
    texts = [prose(rng, rng.randint(1, 400)) for _ in range(150)]
    sources = [rng.choice("ab") for _ in texts]
    rows = mixing.mix_sources(documents(spark, texts, "en", sources)).collect()
    for s in "ab":
        own = [r for r in rows if r.source == s]
        mean = own[0].source_size / len(own)
        rate = lambda m, x: 2 / (1 + math.exp(-m * (0.5 + x / (x + mean))))  # noqa: B023, E731
        low, high = -60.0, 60.0
        for _ in range(200):
            m = (low + high) / 2
            low, high = (m, high) if sum(rate(m, r.size) * r.size for r in own) < own[0].target else (low, m)
        if own[0].target < 1.999 * own[0].source_size:
            assert all(r.rate == pytest.approx(rate(m, r.size), rel=1e-6) for r in own)
    one = "five words are in here"
    same = spark.createDataFrame([(7 if i % 2 else None, one, "en", "a", None) for i in range(400)] + [(9, one, "en", "b", None)] * 201, SCHEMA)
    mixed = mixing.mix_sources(same).collect()
    taken = collections.Counter()
    for r in mixed:
        taken[r.source] += r.taken
        assert r.taken <= 10
    target = {r.source: r.target for r in mixed}
    assert len(mixed) == 601 and all(abs(taken[s] - target[s]) <= 10 for s in "ab")
    assert mixing.repeat_documents(same).count() * 5 == sum(taken.values())


def test_mix_of_nothing(spark):
    assert mixing.mix_sources(documents(spark, [None, ""])).select("taken", "target").distinct().collect()[0][0] == 0


# 4 Pitman-Yor


def test_language_model_base_and_held_out(spark):
    rng = random.Random(8)
    texts = [*ODD, *(prose(rng, rng.randint(0, 300), 3000) for _ in range(150))]
    rows = pitman_yor.score_documents(documents(spark, texts)).collect()
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    counts = collections.Counter(x for d, t in enumerate(texts) if not held(d) for x in [*lowered(t), None])
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        w = [*lowered(texts[r.doc_id]), None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(w), sum(counts[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        assert r.score < 0
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_score_against_a_plain_chinese_restaurant(spark):
    """Long chains of a seating kept customer by customer, with the same discounts, against the operator's average."""
    rng = random.Random(5)
    texts = [" ".join(rng.choices("abcde", k=rng.randint(3, 9), weights=[8, 4, 2, 1, 1])) for _ in range(14)]
    d, d0, s, train = 0.6, 0.4, pitman_yor.STRENGTH, [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1]
    pairs = [x for t in train for x in zip([None, *t.split()], [*t.split(), None], strict=True)]
    count, total = collections.Counter(pairs), collections.Counter(u for u, _ in pairs)
    sizes = {p: [1] * c for p, c in count.items()}
    known = {w for _, w in pairs}

    def parent(w):
        served, tables = sum(len(x) for (_, v), x in sizes.items() if v == w), sum(map(len, sizes.values()))
        return ((served - d0) if served else s + d0 * len(known)) / (s + tables)

    def p(u, w):
        tables = sum(len(x) for (v, _), x in sizes.items() if v == u)
        return (count[u, w] - d * len(sizes.get((u, w), ())) + (s + d * tables) * parent(w)) / (s + total[u])

    probes, sums, draw = [*{(u, w) for u in known for w in [*known, "new"]}], collections.Counter(), random.Random(6)
    for sweep in range(500):
        for (u, w), c in count.items():
            for _ in range(c if c > 1 else 0):
                mine = sizes[u, w]
                at = draw.choices(range(len(mine)), weights=mine)[0]
                mine[at] -= 1
                mine[:] = [x for x in mine if x]
                tables = sum(len(x) for (v, _), x in sizes.items() if v == u)
                new = (s + d * tables) * parent(w)
                at = draw.choices(range(len(mine) + 1), weights=[*(x - d for x in mine), new])[0]
                mine[at : at + 1] = [mine[at] + 1] if at < len(mine) else [1]
        if sweep >= 100:
            for x in probes:
                sums[x] += p(*x) / 400
    for u in known:
        assert sum(sums[u, w] for w in [*known, "new"]) == pytest.approx(1)
    rows = pitman_yor.score_documents(documents(spark, texts), samples=16, burn_in=4, discounts=(d, d0)).collect()
    for r in rows:
        w = [None, *texts[r.doc_id].split(), None]
        assert r.score == pytest.approx(sum(math.log10(sums[x]) for x in zip(w, w[1:], strict=False)), abs=0.04 * r.n_tokens)


def test_one_shard_or_many_agree(spark):
    rng = random.Random(9)
    texts = [prose(rng, 40, 60) for _ in range(80)]
    one, many = ({r.doc_id: r for r in pitman_yor.score_documents(documents(spark, texts), samples=3, shard_tokens=n).collect()} for n in (10**6, 500))
    for d, r in one.items():
        assert (r.n_known, r.base_score) == (many[d].n_known, pytest.approx(many[d].base_score))
        assert r.score == pytest.approx(many[d].score, abs=0.03 * r.n_tokens)


def test_moves_leave_the_conditional_as_it_is():
    rng, d, a, c = np.random.default_rng(1), 0.5, 1.3, 6
    stirling = np.zeros((c + 1, c + 2))
    stirling[1, 1] = 1
    for k in range(1, c):
        for t in range(1, c + 1):
            stirling[k + 1, t] = stirling[k, t - 1] + (k - d * t) * stirling[k, t]
    weights = stirling[c, 1 : c + 1] * a ** np.arange(1, c + 1)
    many = np.full(30000, c)
    flat = lambda pairs, now: np.full(len(pairs), a)
    tables, sizes = np.ones(30000, np.int64), many.copy()  # far from it at first
    for _ in range(12):
        tables, sizes = pitman_yor.gibbs_sweep(many, tables, sizes, flat, d, 4, rng)
    assert np.abs(np.bincount(tables, minlength=c + 1)[1:] / 30000 - weights / weights.sum()).max() < 0.012
    assert (np.add.reduceat(sizes, np.cumsum(tables) - tables) == c).all()
    count = np.array([2, 31, 33, 50_000, 3])
    tables, sizes = pitman_yor.seat_first(count, lambda pairs, now: np.full(len(pairs), 2.0), d, rng)
    assert (np.add.reduceat(sizes, np.cumsum(tables) - tables) == count).all() and len(sizes) == tables.sum()


def test_all_customers_are_seated_by_the_restaurant():
    """Tables, and squares of their sizes, of pairs with many customers beside a restaurant that is filled one by one."""
    c, d, many = 300, 0.6, 1500
    weight = lambda pairs, now: 0.5 + 0.3 * now
    tables, sizes = pitman_yor.seat_first(np.full(many, c), weight, d, np.random.default_rng(2))
    squares = np.add.reduceat(sizes**2, np.cumsum(tables) - tables)
    plain, draw = [], random.Random(2)
    for _ in range(many):
        mine = [1]
        while sum(mine) < c:
            n, t = sum(mine), len(mine)
            if draw.random() * (n - d * t + 0.5 + 0.3 * t) >= n - d * t:
                mine.append(1)
            else:
                mine[draw.choices(range(t), weights=[x - d for x in mine])[0]] += 1
        plain.append((len(mine), sum(x * x for x in mine), mine[0]))
    first = sizes[np.cumsum(tables) - tables]
    for got, wanted in zip((tables, squares, first), np.array(plain).T, strict=True):
        for f in (np.mean, np.std):
            assert f(got) == pytest.approx(f(wanted), rel=0.08)
    assert (np.add.reduceat(sizes, np.cumsum(tables) - tables) == c).all() and sizes.min() == 1


def test_context_is_the_whole_word_before(spark):
    rng = random.Random(3)
    follower = {f"longer{i}": f"follows{rng.randrange(400)}" for i in range(400)}  # no word has 4 bytes or fewer
    texts = [" ".join(x for k in rng.choices(list(follower), k=60) for x in (k, follower[k])) for _ in range(120)]
    rows = [r for r in pitman_yor.score_documents(documents(spark, texts)).collect() if r.held_out]
    scored = sum(r.score for r in rows) / sum(r.n_tokens for r in rows)
    assert scored > -2  # a known follower costs next to nothing, a key log10(400) = 2.6; a unigram costs 2.6 for each


def test_blocks_hold_a_pair_once():
    texts = [b"the cat the cat the cat " * 1000, b"the cat"]
    token, context, owner = pitman_yor.tokens_of(texts)
    assert len(token) == 6000 + 1 + 3 and context[0] == context[6001] == 0 and (context[1:6001] == token[:6000]).all()
    frame = pd.DataFrame({"doc_id": [1, 2], "text": [t.decode() for t in texts], "held_out": [False, True]})
    with pytest.MonkeyPatch.context() as m:
        m.setattr(pitman_yor.TaskContext, "get", lambda: types.SimpleNamespace(partitionId=lambda: 3))
        (block,) = pitman_yor.blocks_of(iter([frame]))
    (sent,) = pitman_yor.pairs_to_shards(1)(iter([block]))
    counted = pitman_yor.count_shard(1)(sent).set_index("kind")
    assert counted.loc["seats", ["n1", "n2"]].tolist() == [2, 0] and sorted(pitman_yor.unpack(counted.loc["seats", "data"])[2]) == [2999, 3000]  # not a row a token


# 5 BPE


@pytest.fixture(scope="module")
def encoding():
    import public_tokenizers as p

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(p.path(bpe.VOCABULARY), "rb"))}
    return tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(spark, texts, encoding):
    rng = random.Random(5)
    parts = ["'", "s", "re", "ll", "t", " ", "  ", "\n", "\t", "a", "Z", "é", "1", "٣", "!", " ", "日本", "😀", "\r\n", " '", "\x00", "́", "\x1c", "the"]
    more = [*texts, "a" * 5000, " " * 300, "ab" * 700, *("".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(3000))]
    rows = bpe.encode_documents(documents(spark, more).withColumn("n_tokens", F.lit(1))).collect()
    for r in rows:
        expected = encoding.encode_ordinary(more[r.doc_id] or "")
        assert np.frombuffer(r.token_ids, "<u4").tolist() == expected and r.n_tokens == len(expected)
        assert bytes(r.decoded) == (more[r.doc_id] or "").encode()
        assert np.frombuffer(r.token_ends, "<u4").tolist() == np.cumsum([len(encoding.decode_single_token_bytes(x)) for x in expected]).tolist()
    again = bpe.decode_documents(bpe.encode_documents(documents(spark, texts), decode=False)).collect()
    assert all(bytes(r.decoded) == (texts[r.doc_id] or "").encode() for r in again)
    digest = bpe.digests(documents(spark, texts)).where("doc_id = 20").first()
    assert digest.ids_sha256 == hashlib.sha256(np.array(encoding.encode_ordinary(texts[20]), "<u4").tobytes()).hexdigest()


# 6 line dedup


def test_patience_alignment():
    aligned = lambda *pairs: line_dedup.aligned(*map(np.array, zip(*pairs, strict=True))).tolist()
    assert aligned((0, 1), (1, 2), (2, 3)) == [True] * 3 and aligned((0, 2), (1, 0), (2, 1)) == [False, True, True]
    assert sum(aligned((0, 5), (1, 5), (2, 6))) == 2 and aligned((0, 1), (0, 1), (1, 2)) == [True] * 3
    rng = random.Random(3)
    for _ in range(300):
        i = np.array([rng.randrange(9) for _ in range(rng.randint(1, 12))])
        j = np.array([rng.randrange(9) for _ in i])
        keep = line_dedup.aligned(i, j)
        kept = np.array(sorted(set(zip(i[keep].tolist(), j[keep].tolist(), strict=True))))
        assert keep.any() and (np.diff(kept, axis=0) > 0).all()


def lines_by_brute_force(texts, least=8):
    """Positions of lines that are in a run of ``least`` words or more that an earlier document has, and of the blank ones between such lines."""
    seen, out = set(), []
    for t in texts:
        rows = [(k, x.strip(" \t\x0b\x0c\r")) for k, x in enumerate((t or "").split("\n"))]
        rows = [(k, x, len(WORDS.findall(x))) for k, x in rows if x]
        runs = [(a, b, tuple(x for _, x, _ in rows[a:b])) for a in range(len(rows)) for b in range(a + 1, len(rows) + 1) if sum(n for _, _, n in rows[a:b]) >= least]
        gone = sorted({k for a, b, x in runs if x in seen for k in range(a, b)})
        lines = {rows[k][0] for k in gone}
        for a, b in zip(gone, gone[1:], strict=False):
            lines |= set(range(rows[a][0], rows[b][0])) if b == a + 1 else set()
        out.append(sorted(lines))
        seen |= {x for _, _, x in runs}
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(12)
    pool = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([1, 2, 3, 5, 9]))) for _ in range(25)] + [""] * 6
    texts = ["\n".join(rng.choices(pool, k=rng.randint(0, 9))) for _ in range(60)]
    texts += ["\n".join(x for t in rng.sample(texts, 2) for x in t.split("\n")) for _ in range(40)]
    rows = {r.doc_id: r for r in line_dedup.line_dedup(documents(spark, texts)).collect()}
    brute = lines_by_brute_force(texts)
    # a blank line between lines that two different documents have stays
    full = lambda d, at: [k for k in at if texts[d].split("\n")[k]]
    assert [full(d, rows[d].removed_lines) for d in range(100)] == [full(d, x) for d, x in enumerate(brute)] and sum(map(len, brute)) > 100
    assert all(set(rows[d].removed_lines) <= set(x) for d, x in enumerate(brute))


def test_a_document_of_many_owners(spark):
    """10,000 lines, each of which another document has first: rows stay as many as lines."""
    rng = random.Random(2)
    lines = [" ".join(f"{rng.getrandbits(24):x}" for _ in range(9)) for _ in range(10_000)]
    docs = documents(spark, [*lines, "\n".join(lines)])
    began = time.time()
    (last,) = line_dedup.line_dedup(docs).where("doc_id = 10000").collect()
    assert last.n_removed == 10_000 and last.text == "" and time.time() - began < 60
    both = documents(spark, ["\n".join(lines), "\n".join(x for a, b in zip(lines[::2], lines[1::2], strict=True) for x in (b, a))])
    assert [r.n_removed for r in line_dedup.line_dedup(both).orderBy("doc_id").collect()] == [0, 10_000]
    assert [r.n_removed for r in line_dedup.line_dedup(both, moved=False).orderBy("doc_id").collect()] == [0, 5_000]


def test_line_dedup_deletes_from_later_documents(spark):
    rng = random.Random(9)
    line = lambda n: " ".join(f"q{rng.getrandbits(30)}" for _ in range(n))
    passage, tail = [line(30), line(4), line(25)], [line(12), line(3)]
    docs = ["\n".join([line(9), *passage, line(9)]), "\n".join([line(9), *passage]), "\n".join([*tail, line(11)]), "\n".join([*passage[::-1], *tail]), None, "", "short\nlines", "short\nother", "\n".join(passage)]
    rows = {r.doc_id: r for r in line_dedup.line_dedup(documents(spark, docs).withColumn("n_removed", F.lit(0))).collect()}
    assert {d: r.removed_lines for d, r in rows.items()} == {0: [], 1: [1, 2, 3], 2: [], 3: [0, 2, 3, 4], 4: [], 5: [], 6: [], 7: [], 8: [0, 1, 2]}
    assert rows[0].text == docs[0] and rows[1].text == docs[1].split("\n")[0] and rows[4].text is None and rows[8].text == ""
    left = {r.doc_id for r in line_dedup.line_dedup(documents(spark, docs), drop_emptied=True).collect()}
    assert 8 not in left and {0, 1, 2, 4, 5, 6, 7} <= left


def test_lines_go_by_alignment(spark, monkeypatch):
    rng = random.Random(8)
    line = lambda: " ".join(f"q{rng.getrandbits(30)}" for _ in range(9))
    blocks = [line() for _ in range(8)]
    order = [0, 1, 2, 5, 3, 4, 7, 6]
    docs = documents(spark, ["\n".join(blocks), "\n".join(blocks[k] for k in order)])
    removed = lambda **how: line_dedup.line_dedup(docs, **how).where("doc_id = 1").first().removed_lines
    spine = [order.index(k) for k in (0, 1, 2, 3, 4)]  # what a plain patience diff aligns, and one of the last two
    aligned_only = removed(moved=False)
    assert set(spine) <= set(aligned_only) and len(aligned_only) == 6 and removed() == [*range(8)]
    i, j = np.array([0, 1, 2]), np.array([5, 4, 3])
    assert line_dedup.blocks(i, j, True).all() and line_dedup.blocks(i, j, False).sum() == 1
    real = line_dedup.aligned
    monkeypatch.setattr(line_dedup, "aligned", lambda i, j: np.zeros(len(i), bool) if len(i) < 3 else real(i, j))
    assert not line_dedup.blocks(i[:2], j[:2], True).any()  # nothing goes that isn't aligned


def test_line_dedup_of_frequent_and_short_lines(spark):
    line = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    copies = ["\n".join(line(f"copy{k}w", 12) for k in range(3))] * 30  # lines of 8 to 19 words, in more than 20 documents
    verse = "\n".join(line(f"verse{k}w", 3) for k in range(6))
    words = "\n".join(f"item{k}" for k in range(9))
    passages = [f"{line(f'own{i}{x[0]}', 9)}\n{x}\n{line(f'end{i}{x[0]}', 9)}" for x in (verse, words) for i in range(25)]
    short = [f"only\nseven words\nin a passage\n{line(f'rest{i}w', 9)}" for i in range(3)]  # 6 words: stays
    rows = {r.doc_id: r for r in line_dedup.line_dedup(documents(spark, copies + passages + short)).collect()}
    assert [rows[d].removed_lines for d in range(30)] == [[], *[[0, 1, 2]] * 29]
    same = [rows[30 + d].removed_lines for d in range(50)]
    assert same == [[], *[[*range(1, 7)]] * 24, [], *[[*range(1, 10)]] * 24]
    assert [rows[80 + d].removed_lines for d in range(3)] == [[], [], []]


# 7 Kneser-Ney


def test_kneser_ney_equals_brute_force(spark):
    rng = random.Random(10)
    train = [prose(rng, 40, 60) for _ in range(30)]
    model = kneser_ney.train(documents(spark, train))
    c = collections.Counter()
    for t in train:
        w = ["<s>", *lowered(t), "</s>"]
        c.update(zip(w, w[1:], strict=False))

    def discounts(values):
        n = [0] + [sum(v == k for v in values) for k in (1, 2, 3, 4)]
        y = n[1] / (n[1] + 2 * n[2])
        return [min(k - 0.05, max(0.05, k - (k + 1) * y * n[k + 1] / n[k])) if n[k] else 0.5 for k in (1, 2, 3)]

    d, cont = discounts(c.values()), collections.Counter(w for _, w in c)
    e = discounts(cont.values())
    total, n = collections.Counter(), sum(cont.values())
    given = collections.Counter()
    for (u, _), x in c.items():
        total[u] += x
        given[u] += d[min(x, 3) - 1]
    unseen = sum(e[min(x, 3) - 1] for x in cont.values()) / n / (len(cont) + 1)
    share = lambda w: (cont[w] - e[min(cont[w], 3) - 1]) / n + unseen if w in cont else unseen

    def p(u, w):
        own = (c[u, w] - d[min(c[u, w], 3) - 1]) / total[u] if (u, w) in c else 0
        return own + (given[u] / total[u] if u in total else 1) * share(w)

    probe = [train[0], "w1x w2x never seen", "", None, *(prose(rng, 20, 80) for _ in range(5))]
    wanted = []
    for t in probe:
        w = ["<s>", *lowered(t), "</s>"]
        pairs = list(zip(w, w[1:], strict=False))
        wanted.append((len(pairs), *(pytest.approx(sum(math.log10(p(*x)) for x in some), rel=1e-10) for some in (pairs, set(pairs)))))
    texts = documents(spark, probe).select(F.col("doc_id").alias("_id"), F.lit("en").alias("_lang"), "text")
    for sizes in ((400_000, 1 << 20), (90, 1 << 20), (90, 300)):  # one shard or many, each once or repeated
        got = kneser_ney.score(texts, model, *sizes).orderBy("_id").collect()
        assert [(r.tokens, r.log10, r.once) for r in got] == wanted and [(r._id, r._lang) for r in got] == [(i, "en") for i in range(len(probe))]


def test_kneser_ney_in_rounds_with_repeated_shards(spark):
    rng = random.Random(13)
    model = kneser_ney.train(documents(spark, [prose(rng, 40, 60) for _ in range(30)]))
    texts = [*(prose(rng, 5, 80) for _ in range(40)), "", None, "w1x never seen"]
    rows = [(None if i % 7 == 0 else i // 2, "en", t) for i, t in enumerate(texts)] * 2  # null and repeated ids
    docs = spark.createDataFrame(rows, "_id long, _lang string, text string").repartition(3)
    found = []
    for sizes in ((400_000, None, 1), (90, None, 1), (90, 1_000, 5), (90, 50, 3)):
        found.append(sorted(((-1 if r._id is None else r._id), r._lang, r.tokens, round(r.log10, 8), round(r.once, 8)) for r in kneser_ney.score(docs, model, *sizes).collect()))
    assert len(found[0]) == len(rows) and all(x == found[0] for x in found)


def test_kneser_ney_works_on_less_than_a_quarter_at_once(spark, monkeypatch):
    rng = random.Random(15)
    model = kneser_ney.train(documents(spark, [prose(rng, 40, 60) for _ in range(10)]))
    docs = documents(spark, [prose(rng, 20, 40) for _ in range(600)]).select(F.col("doc_id").alias("_id"), F.lit("en").alias("_lang"), "text")
    asked, of_round = [], kneser_ney.of_round
    monkeypatch.setattr(kneser_ney, "ROUND_BYTES", 100)
    monkeypatch.setattr(kneser_ney, "of_round", lambda k, rounds, *columns: asked.append((k, rounds, columns)) or of_round(k, rounds, *columns))
    scored = kneser_ney.score(docs, model)
    for columns, rows in ((("_id", "text"), docs), (("u", "w"), model["pairs"])):
        sizes = [rows.where(of_round(*x[:2], *columns)).count() for x in asked if x[2] == columns]
        assert sum(sizes) == rows.count() and max(sizes) < 0.24 * rows.count()
    assert sorted(r._id for r in scored.collect()) == list(range(600))


def test_kneser_ney_sends_a_key_once_however_many_shards(spark):
    rng = random.Random(14)
    texts = [prose(rng, 50, 200) for _ in range(60)] + ["", None]
    docs = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "_id long, _lang string, text string").coalesce(1)
    bits = spark.sparkContext.broadcast(np.full(1 << 12, 255, np.uint8))
    distinct = len(np.unique(kneser_ney.count_keys(texts, bits.value)[2]))
    for shards in (1, 7, 200):
        rows = docs.mapInPandas(kneser_ney.keys_to_shards(bits, shards, 1), kneser_ney.PACKED).collect()
        asked = pd.DataFrame([(r.key, bytes(r.data)) for r in rows if r.key >= 0], columns=["key", "data"])
        assert len(rows) - len(asked) == 1 and len(asked) <= shards  # a block's counts go once
        keys = [kneser_ney.keys_of(kneser_ney.unpack(x)[2]) for x in asked["data"]]
        assert sum(map(len, keys)) == distinct
        answers = []
        for (key, own), k in zip(asked.groupby("key"), keys, strict=True):
            shard = kneser_ney.pack_shard(pd.DataFrame({"h": k[::2].view(np.int64), "shard": key, "a": 1.0, "b": 2.0}))
            answers.append(kneser_ney.look_up(shard, own))
        got = [kneser_ney.unpack(x) for x in pd.concat(answers)["data"]]
        assert sum(len(x[0]) for x in got) == sum(len(k[::2]) for k in keys)  # a value for each key that is there, none for each document


def test_kneser_ney_block_in_pieces():
    rng = random.Random(11)
    texts = [prose(rng, 1, 60) for _ in range(40)] + ["", None, long := "w1x " * 500]
    bits = np.full(1 << 12, 255, np.uint8)
    tokens, pairs, keys, counts = kneser_ney.count_keys(texts, bits)
    for piece in (1, 300, len(long), 1 << 20):
        got = kneser_ney.count_block(texts, bits, piece)
        assert (got[0] == tokens).all() and (got[1] == pairs).all()
        rows = lambda k, c: sorted(zip(k.tolist(), *c.tolist(), strict=True))
        assert rows(got[2], got[3]) == rows(keys, counts)


def test_classifier_rejects_junk(spark):
    rng = random.Random(12)
    good = [prose(rng, 80, 300) for _ in range(300)]
    junk = [" ".join(f"{rng.getrandbits(40):x}%%" for _ in range(80)) for _ in range(10)]
    docs = documents(spark, [*good, *junk, None, "", "w1x " * 200, "w1x w2x w1x w3x " * 90], ["en", "fr", None])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)] + [(300, 0, 0)], "doc_id LONG, quality INT, toxic INT")
    rows = {r.doc_id: r for r in kneser_ney.classify(docs, labels).collect()}
    assert len(rows) == 314 and sum(rows[i].kept for i in range(300)) > 270 and not any(rows[i].kept for i in [*range(300, 310), 312, 313])
    held = labels.where(F.xxhash64(F.lit(7), "doc_id") % 2 != 0).where("quality = 1").select("doc_id").collect()
    for lang in ("en", "fr"):
        x = sorted(rows[r.doc_id].perplexity for r in held if rows[r.doc_id].lang == lang)
        y = sorted(rows[r.doc_id].novelty for r in held if rows[r.doc_id].lang == lang)
        ends = np.quantile(x, 0.003) / 1.1, np.quantile(x, 0.99) * 1.1, np.quantile(y, 0.005) / 1.1
        for r in rows.values():
            if r.lang == lang:
                assert (r.lowest, r.highest, r.least_novelty) == tuple(pytest.approx(v) for v in ends)
    assert all(r.kept == (r.lowest <= r.perplexity <= r.highest and r.novelty >= r.least_novelty) for r in rows.values())
    joined = {r.doc_id: r for r in kneser_ney.classify(docs, labels, shard_keys=500, salt_bytes=20_000).collect()}
    assert all(joined[d].kept == r.kept and joined[d].perplexity == pytest.approx(r.perplexity, rel=1e-10) for d, r in rows.items())
    assert all(r.kept for r in kneser_ney.classify(docs, labels.where("quality > 1")).collect())


def test_classifier_takes_all_trusted_documents(spark):
    n = 14_000  # more than 6000 in each half
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("own"), "id", F.lit(" and own"), F.col("id") + 1).alias("text"), F.lit("en").alias("lang"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    rows = {r.doc_id: r for r in kneser_ney.classify(docs, labels).collect()}
    first = {r.doc_id for r in labels.where(F.xxhash64(F.lit(7), "doc_id") % 2 == 0).collect()}
    known = max(rows[i].perplexity for i in first)  # learned from: a unique text that's seen is likelier than one that isn't
    strangers = [i for i in range(1, n - 1) if not {i - 1, i, i + 1} & first]
    assert len(first) > 6000 and len(rows) == n and known < min(rows[i].perplexity for i in strangers)
    x = sorted(rows[i].perplexity for i in range(n) if i not in first)
    assert len(x) > 6000 and rows[0].highest == pytest.approx(np.quantile(x, 0.99) * 1.1, rel=1e-12) and rows[0].lowest == pytest.approx(np.quantile(x, 0.003) / 1.1, rel=1e-12)


@pytest.mark.parametrize("share", [0.0, 0.003, 0.5, 0.99, 1.0])
def test_quantiles_of_languages_with_copies(spark, share):
    rng = random.Random(4)
    rows = [(rng.choice(["en", "fr", None]), float(rng.choice([0, 1, 1, 1, rng.random()])), rng.random()) for _ in range(500)] + [("one", 5.0, 6.0)]
    got = {(r._all, r._lang): r for r in kneser_ney.quantiles(spark.createDataFrame(rows, "_lang string, x double, y double"), {"x": share, "y": share}).collect()}
    assert len(got) == 5
    for (every, lang), r in got.items():
        own = [x for x in rows if every or x[0] == lang]
        assert r._n == len(own) and r.x == pytest.approx(np.quantile([x[1] for x in own], share)) and r.y == pytest.approx(np.quantile([x[2] for x in own], share))


# 8 HTML

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1><a href=x>Home</a></header><nav><ul><li><a href="/a">menu one</a></li></ul></nav>
<div class="sidebar"><p>Side words here that are many and long enough to count</p></div><div id="content"><h2>Head &amp; title</h2><p>First para of the <i>ma</i>in text, with many words
 in it, indeed so.<p>Second para&nbsp;of text &copy, also with a good number of words.<ul><li>item one of a list</li><li>item two</li></ul><div class="cookie-notice">We use cookies</div>
<script>var x = "</p>";</script><p>Third para after the notice, closing the story here.</p></div><form><input><label>Name</label></form><div id="comments"><p>Great post, I loved it!</p></div><footer>2020</footer></body></html>"""
ARTICLE = "Head & title First para of the main text, with many words in it, indeed so. Second para of text ©, also with a good number of words. item one of a list item two Third para after the notice, closing the story here."


def test_html_text(spark):
    labelled = [f"<body><nav><a href=/>go {i}</a></nav><div class=ad>buy</div><article><h1>T{i}</h1><p>some words of an article number {i}<br>and more of them</p></article><footer>f</footer>" for i in range(30)]
    odd = [None, "", "<p", "plain words only", "<nav>only a menu</nav>", "<!-- <p>x</p> -->", "<p>a<p>b<b>c"]
    pages = spark.createDataFrame([(i, f"u{i}", h, 0) for i, h in enumerate([*labelled, PAGE, *odd])], "page_id LONG, url STRING, html STRING, text INT")
    rows = {r.page_id: r for r in html_text.extract_text(pages).collect()}
    assert all(rows[i].text == f"T{i} some words of an article number {i} and more of them" for i in range(30))
    assert rows[30].text == ARTICLE and rows[30].n_chars == len(ARTICLE)
    assert [rows[31 + i].text for i in range(len(odd))] == ["", "", "", "plain words only", "", "", "a bc"]
    assert html_text.main_text(PAGE, {}) == ARTICLE


def test_learned_places_decide_the_run(spark, monkeypatch):
    """Boxes that no list names go because labelled pages have them outside their articles only."""
    box = "<div class=zq7><p>offers of the day and more of the same here</p></div>"
    labelled = [f"<body>{box}<article><h1>T{i}</h1><p>some words of an article number {i}<br>and more of them</p></article><div class=kx>words below it</div>" for i in range(60)]
    bare = f"<body>{box}<div><p>the story as it is told without marks, long enough</p><p>and a second part of it, in as many words</p></div><div class=kx>words below it</div>"
    story = "the story as it is told without marks, long enough and a second part of it, in as many words"
    pages = spark.createDataFrame([(i, f"u{i}", h) for i, h in enumerate([*labelled, bare])], "page_id LONG, url STRING, html STRING")
    weights = html_text.learn_weights(pages, "url", "html")
    assert weights["word/div.zq"] < 0 < weights["word/article"] and html_text.main_text(bare, weights) == story
    assert {r.text for r in html_text.extract_text(pages).where("page_id = 60").collect()} == {story}

    def brute(page):  # every run of tokens, of ties the longest
        seen = [(k, t, bad, (len(t.split()) if k.startswith("word/") else 1) * html_text.score(k, weights)) for k, t, bad, _ in html_text.tokens(page)]
        runs = [(sum(x[3] for x in seen[i:j]), j - i, i, j) for i in range(len(seen)) for j in range(i + 1, len(seen) + 1)]
        _, _, i, j = max(runs)
        return " ".join(" ".join(x[1] for x in seen[i:j] if x[0].startswith("word/") and not x[2]).split())

    assert brute(bare) == story and all(brute(x) == html_text.main_text(x, weights) for x in labelled[:5])
    monkeypatch.setattr(html_text, "best_run", lambda scores: (0, len(scores)))
    assert html_text.main_text(bare, weights) != story


@pytest.mark.parametrize("page", ["<a \"'" * 300_000, "<a =\"x" * 150_000, "<nav>" + "<div>" * 50_000 + "</aside>" * 50_000, "<!--" * 250_000, "<" * 1_000_000, "<a " + 'x="" ' * 300_000 + ">", "<a " + 'x=">" ' * 300_000 + ">", "<div class='" + "k " * 300_000 + "'>" + "<i>x</i>" * 50_000])
def test_long_broken_pages_take_linear_time(page):
    began = time.process_time()
    html_text.main_text(page, {})
    assert time.process_time() - began < 3


def test_tags_end_outside_quotes():
    cases = {'<p x="a>b" y=\'>\'>t': 't', '<p x=">">t': "t", '<p x="a>t': "t", '<p x="" y="" z=">" "> t': "t", '<p x = ">" y>t': "t"}
    assert {page: page[html_text.tag_end(page, 2) :].strip() for page in cases} == cases
    long = "k" * 50
    assert html_text.place_name("div", f' class="{long}a"') != html_text.place_name("div", f' class="{long}b"')


def test_best_run_is_the_largest_sum():
    rng = random.Random(0)
    for _ in range(300):
        x = [rng.randint(-5, 5) for _ in range(rng.randint(0, 12))]
        first, last = html_text.best_run([float(v) for v in x])
        assert sum(x[first:last]) == max([0, *(sum(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1))])


# 9 toxicity


def test_toxicity_equals_brute_force(spark):
    rng = random.Random(31)
    bad = ["vermin", "vermins", "grolk", "grolkish", "snarf"]
    texts = []
    for i in range(500):
        w = prose(rng, 20, 60).split()
        if i % 5 == 0:
            w[rng.randrange(len(w))] = rng.choice(bad)
        if i % 7 == 0:
            w[3:5] = ["snarf", "blanket"]
        texts.append(" ".join(w))
    toxic = [int(i % 5 == 0) for i in range(500)]
    # one id has many rows: its smallest text is learned from once, however many there are
    extra = [(7, "zzz vermin zzz")] * 300 + [(500, None), (501, ""), (None, "a grolk!")]
    docs = spark.createDataFrame([*enumerate(texts), *extra], "doc_id LONG, text STRING")
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)] + [(5, 1, 0)], "doc_id LONG, quality INT, toxic INT")
    plain = toxicity.learn(docs.where("NOT (doc_id = 7 AND text LIKE 'zzz%')"), labels)
    terms, phrases, beta = toxicity.learn(docs, labels)
    assert (terms, phrases) == plain[:2] and beta == pytest.approx(plain[2], rel=1e-9)

    # the lexicon: documents with each word or beginning, counted one by one
    learned, harmless = toxicity.learn_lexicon(spark.createDataFrame(list(zip(texts, toxic, strict=True)), "text STRING, toxic INT"))
    of = [{f" {w} " for w in t.split() if len(w) > 2} | {" " + w[:n] for w in t.split() for n in range(4, 9) if len(w) > n} for t in map(toxicity.fold, texts)]
    n = [400, 100]
    wanted = {}
    for term in set().union(*of):
        b, a = (sum(term in x for x, y in zip(of, toxic, strict=True) if y == k) for k in (0, 1))
        if a >= 3:
            odds = math.log((a + 0.5) / (n[1] - a + 1)) - math.log((b + 0.5) / (n[0] - b + 1))
            weight = odds - 1.64 * math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
            if weight > 1:
                wanted[term] = pytest.approx(weight, rel=1e-9)
    assert wanted and dict(learned) == wanted and set(toxicity.EXCEPTIONS) <= set(harmless)

    def score(text):
        words, total = toxicity.fold(text).split(), 0.0
        covered = set()
        for phrase in phrases:
            p = phrase.split()
            covered |= {i + j for i in range(len(words)) if words[i : i + len(p)] == p for j in range(len(p))}
        for i, w in enumerate(words):
            own = [v for term, v in terms if (term == f" {w} " if term.endswith(" ") else w.startswith(term[1:]))]
            total += max(own, default=0.0) if i not in covered else 0.0
        z = beta[0] + beta[1] * math.log1p(total) + beta[2] * math.log1p(1000 * total / (len(words) + 50))
        return 1 / (1 + math.exp(-z))

    rows = toxicity.score_toxicity(docs, labels).collect()
    assert len(rows) == 803
    assert [r.score for r in rows] == [pytest.approx(score(r.text), rel=1e-9) for r in rows]
    assert all(r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_toxicity(spark):
    assert toxicity.fold("IDIOT!! 1d10t, а сlоwn$$$ f0o_b@r") == " idiot idiot a clown foo bar "
    rng = random.Random(13)
    clean = [prose(rng, 60) for _ in range(400)]
    toxic = []
    for _ in range(150):
        w = prose(rng, 60).split()
        for _ in range(3):
            w.insert(rng.randrange(60), rng.choice(["Nasty!", "vile", "V1LE", "nаsty", "horrid"]))
        toxic.append(" ".join(w))
    harmless = [prose(rng, 50) + " vile weed garden" for _ in range(60)]
    texts = [*clean, *toxic, *harmless, None, ""]
    labels = spark.createDataFrame([(i, 1, int(400 <= i < 550)) for i in range(len(texts) - 2)], "doc_id LONG, quality INT, toxic INT")
    rows = toxicity.score_toxicity(documents(spark, texts).withColumn("score", F.lit("x")), labels).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert sum(r.predicted == (400 <= r.doc_id < 550) for r in held) >= 0.97 * len(held)
    none = toxicity.score_toxicity(documents(spark, texts[:3]), labels.where("toxic > 1")).collect()
    assert [r.score for r in none] == pytest.approx([0, 0, 0])


def test_exceptions_hide_matches():
    known = toxicity.Lexicon({" vile ": 2.0, " nas": 1.0, " nasty ": 3.0}, ("vile weed",))
    assert known.matches(toxicity.fold("a vile weed and a nasty vile man")) == {18: 3.0, 24: 2.0}


# 10 Order MinHash


def brute_sketch(text, k=3, bins=64, length=2):
    """The fingerprint in plain Python: of each bin the smallest numbered k-mers, in text order."""
    units = re.findall(r"[^\x20\x09-\x0D]{1,16}", text or "")
    signed = lambda x: (x + 2**63) % 2**64 - 2**63
    seen, found = collections.Counter(), collections.defaultdict(list)
    for at in range(max(1, len(units) - k + 1) if units else 0):
        h = 42
        for unit in units[at : at + k]:
            h = xxhash.xxh64_intdigest(unit, h)
        h %= 2**40
        n, seen[h] = seen[h], seen[h] + 1
        wide = h - 2**40 if h >= 2**39 else h
        e = xxhash.xxh64_intdigest(n.to_bytes(4, "little"), xxhash.xxh64_intdigest((wide % 2**64).to_bytes(8, "little"), 42)) % 2**40
        found[e >> 34].append((e, at))
    out = []
    for b in sorted(found, key=lambda x: (x < 32, x)):  # as signed numbers
        code = 42
        for e, _ in sorted(sorted(found[b])[:length], key=lambda x: x[1]):
            code = xxhash.xxh64_intdigest(e.to_bytes(8, "little"), code)
        out.append(signed(b << 32 | code % 2**32))
    return out


def test_order_minhash_equals_brute_force(spark, texts, monkeypatch):
    rng = random.Random(15)
    many = [*texts, "x " * 80, " ".join(rng.choices("ab", k=300)), prose(rng, 700, 30), "y" * 900, "\U0001f600 " * 9]
    rows = documents(spark, many).select("doc_id", order_minhash.sketch(F.col("text")).alias("s")).collect()
    assert {r.doc_id: r.s for r in rows} == {i: brute_sketch(t) for i, t in enumerate(many)}


def test_order_minhash(spark, texts):
    rng = random.Random(14)
    long = [prose(rng, 400, 100000) for _ in range(12)]
    moved = [" ".join(t.split()[200:] + t.split()[:200]) for t in long]
    shuffled = [" ".join(rng.sample(t.split(), 400)) for t in long]
    edited = [" ".join(t.split()[:-20]) for t in long]
    rows = documents(spark, [*long, *moved, *shuffled, *edited]).select("doc_id", order_minhash.sketch(F.col("text")).alias("s")).collect()
    sketches = {r.doc_id: r.s for r in rows}
    pairs = spark.createDataFrame([(i, b, sketches[i], sketches[12 * b + i]) for i in range(12) for b in range(4)], "i INT, b INT, x ARRAY<LONG>, y ARRAY<LONG>")
    near = {r.b: r.n for r in pairs.groupBy("b").agg(F.avg(order_minhash.likeness(F.col("x"), F.col("y"))).alias("n")).collect()}
    assert near[0] == 1 and near[3] > 0.8 > near[1] > 0.3 and near[2] < 0.05  # order counts, not only what is there


def test_order_minhash_numbers_occurrences(spark):
    docs = documents(spark, ["a b c a b c a b c a b c", "a b c", "x " * 50, "x " * 60, None, "", " \n", "a b c a b c a b c a b c"])
    s = {r.doc_id: r.s for r in docs.select("doc_id", order_minhash.sketch(F.col("text")).alias("s")).collect()}
    assert s[0] == s[7] and len(s[1]) == 1 and s[4] == s[5] == s[6] == [] and len(s[2]) > 1


def test_order_minhash_query_text(spark, texts, tmp_path):
    documents(spark, texts, first=100).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    rows = order_minhash.query(spark, str(tmp_path)).collect()
    order = sorted(range(len(texts)), reverse=True)
    assert len(rows) == len(texts)
    by = {r.doc_id - 100: r for r in rows}
    for i, d in enumerate(order):
        own, after = texts[d] or "", texts[order[(i + 1) % len(order)]] or ""
        third = len(own) // 3
        assert by[d].n_chars == len(own)
        assert by[d].edited_sha256 == hashlib.sha256((own[: len(own) - third] + after[:third]).encode()).hexdigest()
        assert 0 <= by[d].near_edited <= 1 and 0 <= by[d].near_next <= 1
    same = collections.defaultdict(set)
    for d, r in by.items():
        same[texts[d]].add(r.fingerprint)
    assert all(len(v) == 1 for v in same.values())


# all: empty tables


def test_empty_tables(spark):
    docs = documents(spark, [])
    labels = spark.createDataFrame([], "doc_id LONG, quality INT, toxic INT")
    pages = spark.createDataFrame([], "page_id LONG, url STRING, html STRING")
    for out in (
        simhash.near_duplicates(docs.select("doc_id", "text")), simhash.deduplicate(docs), quality_rules.quality_rules(docs), mixing.mix_sources(docs), mixing.repeat_documents(docs), pitman_yor.score_documents(docs),
        bpe.encode_documents(docs), line_dedup.line_dedup(docs), kneser_ney.classify(docs, labels), html_text.extract_text(pages), toxicity.score_toxicity(docs, labels), order_minhash.with_next_text(docs),
    ):
        assert out.collect() == []


def test_columns_with_clashing_names_stay(spark):
    names = ["id", "fp", "key", "hash", "words", "a", "b", "n", "size", "token", "w", "high", "low", "root", "owner", "count"]
    docs = documents(spark, ["one two three four five six seven eight", "one two three four five six seven eight nine"]).withColumns({c: F.lit(c) for c in names})
    for out in (simhash.near_duplicates(docs), simhash.deduplicate(docs), quality_rules.quality_rules(docs), mixing.repeat_documents(docs), bpe.encode_documents(docs), line_dedup.line_dedup(docs)):
        rows = out.collect()
        assert rows and all(r[c] == c for r in rows for c in names)


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "alpha beta gamma delta", "en", None, None), (1, "alpha beta gamma delta", None, "s", None), (1, "alpha beta gamma delta", None, "s", None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, None), (None, 1, 1)], "doc_id LONG, quality INT, toxic INT")
    assert simhash.near_duplicates(docs.select("doc_id", "text")).count() == 4
    assert simhash.deduplicate(docs).count() == 4  # rows without an id stay, rows of one id stay together
    assert mixing.mix_sources(docs).count() == 4 and pitman_yor.score_documents(docs).count() == 4
    assert line_dedup.line_dedup(docs).count() == 4 and kneser_ney.classify(docs, labels).count() == 4
    assert toxicity.score_toxicity(docs, labels).count() == 4 and quality_rules.quality_rules(docs).count() == 4
    assert order_minhash.with_next_text(docs).count() == 4

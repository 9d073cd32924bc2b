"""Operator 5: byte-level BPE encoding and decoding.

Pre-tokens are found without a regular expression. Every code point gets a class
(letter, number, white space, other, with one look ahead for contractions and
for the last space of a run), and an automaton of eight states over the classes
tells where a pre-token begins. Its transition functions compose associatively:
blocks of text are composed side by side, the blocks' functions are scanned by
doubling, and every block is then run from its known first state. The slices are
grouped by content; those not in the worker's cache are merged together, each
round joining the lowest-ranked pair of every word. Token ids, and the byte
offset at which each token ends, come back for each text; decoding concatenates
the tokens' bytes.

Defined results: null and empty texts have no tokens and decode to nothing; any
code point round-trips; repeated rows encode alike; an empty table gives an empty
result; columns other than the result's stay as they are.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presentia.llm.common import read_table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
END, LETTER, NUMBER, OTHER, SHORT, LONG, GLUE, LAST, SPACE = range(9)  # classes
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, GLUED, IN_SPACE, ONE_MORE, TWO_MORE = range(8)  # states
BLOCK = 128
PIECE = 1 << 19  # code points handled together
WORDS_KEPT = 300_000  # in a worker's cache
LONG_WORD = 40  # bytes; longer ones are merged one by one
NONE = np.int32(2**31 - 1)
RESULT = T.StructType([T.StructField("n_tokens", T.LongType()), *(T.StructField(c, T.BinaryType()) for c in ("token_ids", "token_ends", "decoded"))])


@cache
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state, and whether a pre-token begins, at class * 8 + state."""
    follow, begins = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    for state in range(8):
        for cls, inside in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS)):
            follow[cls, state], begins[cls, state] = inside, state not in (inside, GLUED)
        for cls, left in ((SHORT, ONE_MORE), (LONG, TWO_MORE)):  # an apostrophe that begins a contraction, unless it is in a run
            run = state in (IN_OTHERS, GLUED)
            follow[cls, state], begins[cls, state] = IN_OTHERS if run else left, not run
        follow[GLUE, state], follow[LAST, state], follow[SPACE, state] = GLUED, START, IN_SPACE
        begins[SPACE, state] = state != IN_SPACE
    follow[1:, ONE_MORE], follow[1:, TWO_MORE] = START, ONE_MORE
    begins[1:, ONE_MORE] = begins[1:, TWO_MORE] = False
    return follow.ravel(), begins.ravel()


@cache
def class_table() -> np.ndarray:
    """The class of each code point, in the library's version of Unicode."""
    table, single = np.full(0x110000, OTHER, np.uint8), {bytes([i]): i for i in range(256)}
    every = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    for cls, kind in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        found = tiktoken.Encoding(kind, pat_str=kind, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)  # what doesn't match is left out
        table[np.frombuffer(bytes(found).decode().encode("utf-32-le"), np.uint32)] = cls
    return table


def classes_of(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Classes with look-ahead; ``ends`` are the positions that end a text."""
    cls = class_table()[points]
    cls[ends] = END
    after, after2 = np.append(cls[1:], END), np.append(points[1:], 0)
    space = (cls == SPACE) & (after != SPACE) & (after != END)
    cls[space] = np.where(points[space] == 0x20, GLUE, LAST)
    mark = np.flatnonzero(points == 0x27)
    if len(mark):
        a, b = after2[mark], np.append(points, [0, 0])[mark + 2]
        a, b = np.where(after[mark] == END, 0, a), np.where(after[mark] == END, 0, b)
        cls[mark[np.isin(a, [ord(c) for c in "stmd"])]] = SHORT
        two = ((b == ord("e")) & ((a == ord("r")) | (a == ord("v")))) | ((a == ord("l")) & (b == ord("l")))
        cls[mark[two]] = LONG
        cls[ends] = END
    return cls


def boundaries(cls: np.ndarray) -> np.ndarray:
    """Positions where pre-tokens begin, by a scan over transition functions."""
    follow, begins = automaton()
    n = len(cls)
    rows = -(-n // BLOCK)
    grid = np.zeros(rows * BLOCK, np.uint8)
    grid[:n] = cls * 8
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T)
    whole = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))  # the function of each block
    for column in grid:
        whole = follow[column[:, None] + whole]
    step = 1
    while step < rows:  # functions of all blocks up to each
        whole[step:] = np.take_along_axis(whole[step:], whole[:-step], axis=1)
        step *= 2
    state = np.append(np.uint8(START), whole[:-1, START])
    out = np.empty((BLOCK, rows), bool)
    for j, column in enumerate(grid):
        at = column + state
        out[j], state = begins[at], follow[at]
    return np.flatnonzero(out.T.ravel()[:n])


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = np.uint64(0x9E3779B97F4A7C15)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    run = lambda x: np.multiply.accumulate(np.append(np.uint64(1), np.full(n, x)))
    return run(base), run(inverse)


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, stretch: int = 1 << 19) -> np.ndarray:
    """64-bit hashes of slices, in order, of a byte array: differences of a polynomial prefix sum, a stretch of bytes at a time."""
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + stretch, side="right")))
        low, high = int(starts[first]), int(ends[last - 1])
        up, down = _powers(1 << int(max(high - low, stretch)).bit_length())
        sums = np.append(np.uint64(0), np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * up[: high - low]))
        a, b = starts[first:last] - low, ends[first:last] - low
        out[first:last] = (sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        first = last
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


class Vocabulary:
    """Ranks of a vocabulary, and a cache of merged words of bounded size."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.lengths = np.array([len(x) for x in self.tokens], np.int64)
        self.offsets = np.append(0, np.cumsum(self.lengths))[:-1]
        self.data = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = {(self.ranks[t[:i]] << 16) | self.ranks[t[i:]]: r for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks}
        self.bits = max(10, (4 * len(pairs)).bit_length())
        self.keys, self.found = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        for key, rank in pairs.items():  # open addressing
            at = int(self._slot(np.int64(key)))
            while self.keys[at] >= 0:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.keys[at], self.found[at] = key, rank
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.bounds = np.empty(0, np.int32), np.zeros(1, np.int64)

    def _slot(self, key):
        return ((key * np.int64(0x9E3779B1)) & np.int64(0xFFFFFFFF)) >> np.int64(32 - self.bits)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that two adjacent tokens merge to, NONE if they don't."""
        key = (left.astype(np.int64) << 16) | right
        at = self._slot(key)
        out, seen = self.found[at], self.keys[at]
        left_over = np.flatnonzero((seen != key) & (seen >= 0))
        out[seen != key] = NONE
        while len(left_over):
            at[left_over] = (at[left_over] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[at[left_over]]
            hit = left_over[seen == key[left_over]]
            out[hit] = self.found[at[hit]]
            left_over = left_over[(seen != key[left_over]) & (seen >= 0)]
        return out

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words, and how many each has: a round merges the leftmost lowest pair of every word."""
        sizes = np.array([len(w) for w in words], np.int64)
        ids = self.single[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        done_ids, done_words = [], []
        while len(ids):
            rank = np.full(len(ids), NONE, np.int32)
            inside = np.flatnonzero(word[:-1] == word[1:])
            rank[inside] = self.pair_ranks(ids[inside], ids[inside + 1])
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            count = np.diff(np.append(first, len(ids)))
            best = np.repeat(np.minimum.reduceat(rank, first), count)
            over = best == NONE
            if over.any():
                done_ids.append(ids[over])
                done_words.append(word[over])
            at = np.flatnonzero((rank == best) & ~over)
            at = at[np.append(True, word[at[1:]] != word[at[:-1]])] if len(at) else at
            ids[at] = rank[at]
            over[at + 1] = True
            ids, word = ids[~over], word[~over]
        word = np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return np.concatenate(done_ids)[order], np.bincount(word, minlength=len(words))

    def merge_long(self, word: bytes) -> np.ndarray:
        """The same for one word of any length, with a heap."""
        n = len(word)
        ids = [int(x) for x in self.single[np.frombuffer(word, np.uint8)]]
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        text = [word[i : i + 1] for i in range(n)]
        pair = lambda i: self.ranks.get(text[i] + text[after[i]]) if after[i] < n else None
        heap = [(r, i, 1, 1) for i in range(n) if (r := pair(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            if not alive[i] or after[i] >= n or len(text[i]) != a or len(text[after[i]]) != b:
                continue
            j = after[i]
            text[i] += text[j]
            ids[i], alive[j], after[i] = r, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and (r := pair(k)) is not None:
                    heapq.heappush(heap, (r, k, len(text[k]), len(text[after[k]])))
        return np.array([x for x, live in zip(ids, alive, strict=True) if live], np.int32)

    def learn(self, words: list[bytes]) -> None:
        """Merge words that aren't known and keep them."""
        short = [w for w in words if len(w) <= LONG_WORD]
        flats, counts = [self.flat], [np.diff(self.bounds)]
        if short:
            ids, n = self.merge(short)
            flats.append(ids)
            counts.append(n)
        long = [w for w in words if len(w) > LONG_WORD]
        for w in long:
            flats.append(self.merge_long(w))
            counts.append(np.array([len(flats[-1])]))
        self.known.update(zip(short + long, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.flat, self.bounds = np.concatenate(flats), np.append(0, np.cumsum(np.concatenate(counts)))

    def slices(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, first code point in it, and number among the known words, of every pre-token of one text or more."""
        sizes = np.array([len(t) + 1 for t in texts])
        joined = "\0".join(texts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        stops = np.cumsum(sizes) - 1
        cls = classes_of(points, stops)
        starts = boundaries(cls)
        ends = np.append(starts[1:], len(points))
        real = cls[starts] != END
        starts, ends = starts[real], ends[real]
        of_text = np.searchsorted(stops, starts)
        places = starts - (stops - sizes + 1)[of_text]
        content = joined.encode("utf-8", "surrogatepass")
        if len(content) != len(points):
            at = np.append(0, np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)))
            starts, ends = at[starts], at[ends]
        if not len(starts):
            return of_text, places, np.empty(0, np.int64)
        _, first, which = np.unique(slice_hashes(np.frombuffer(content, np.uint8), starts, ends), return_index=True, return_inverse=True)
        words = [content[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        if len(self.known) > WORDS_KEPT:
            self.forget()
        if new := [w for w in words if w not in self.known]:
            self.learn(new)
        return of_text, places, np.array([self.known[w] for w in words])[which]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        if not texts:
            return []
        of_text, _, index = self.slices(texts)
        begin, n = self.bounds[index], self.bounds[index + 1] - self.bounds[index]
        ids = self.flat[spread(begin, n)]
        tokens = np.bincount(of_text, weights=n, minlength=len(texts)).astype(np.int64)
        return np.split(ids, np.cumsum(tokens)[:-1])

    def decode(self, ids: np.ndarray) -> bytes:
        return self.data[spread(self.offsets[ids], self.lengths[ids])].tobytes()


def spread(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... n[0] of them, then those of the next."""
    total = int(n.sum())
    return np.repeat(begin - np.append(0, np.cumsum(n))[:-1], n) + np.arange(total)


@lru_cache(maxsize=2)
def vocabulary(content: bytes) -> Vocabulary:
    """The vocabulary of a file of tokens (base 64) and ranks."""
    return Vocabulary({base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)})


def pieces(texts: list[str], limit: int = PIECE) -> Iterator[list[str]]:
    """Runs of texts of about ``limit`` code points."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > limit:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t) + 1
    if run:
        yield run


def encode_documents(docs: DataFrame, text: str = "text", path: str | None = None, decode: bool = True) -> DataFrame:
    """``docs`` with n_tokens, token_ids and token_ends (little-endian unsigned 32-bit) and, unless ``decode`` is off, decoded."""
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file, under 1 MB

    @F.pandas_udf(RESULT)
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vocab = vocabulary(shared.value)
        for batch in batches:
            for run in pieces([t or "" for t in batch]):
                rows = []
                for ids in vocab.encode(run):
                    ends = np.cumsum(vocab.lengths[ids]).astype("<u4").tobytes()
                    rows.append((len(ids), ids.astype("<u4").tobytes(), ends, vocab.decode(ids) if decode else None))
                yield pd.DataFrame(rows, columns=RESULT.names)

    docs = docs.drop(*RESULT.names).withColumn("_encoded", encode(text))
    return docs.select("*", "_encoded.*").drop("_encoded")


def decode_documents(rows: DataFrame, token_ids: str = "token_ids", path: str | None = None) -> DataFrame:
    """``rows`` with decoded, the bytes that packed ids stand for."""
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        shared = rows.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file, under 1 MB

    @F.pandas_udf(T.BinaryType())
    def decode(batch: pd.Series) -> pd.Series:
        vocab = vocabulary(shared.value)
        return pd.Series([vocab.decode(np.frombuffer(x or b"", "<u4")) for x in batch], dtype=object)

    return rows.drop("decoded").withColumn("decoded", decode(token_ids))


def digests(docs: DataFrame) -> DataFrame:
    """Encoded and decoded documents as counts and digests."""
    done = encode_documents(docs.select("doc_id", "text"))
    return done.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: token counts and digests of every document."""
    return digests(read_table(spark, sf_dir, "documents"))

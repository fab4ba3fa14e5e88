"""The trigram model against a plain one with exact probabilities, with and without split contexts."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from quadloom.llm import ngram

SCHEMA = "doc_id long, text string, score double, shard int, held_out string"


def fold(doc_id, modulus):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus


def tokens(text):
    return [*(text or "").encode().lower().split(), b"\n"]


class Plain:
    def __init__(self, train):
        self.one, self.two, self.three, self.after = Counter(), Counter(), Counter(), {}
        for t in train:
            w = tokens(t)
            self.one.update(w)
            self.two.update(zip([b"\n", *w[:-1]], w, strict=True))
            self.three.update(zip([b"\n", *w[:-2]], w[:-1], w[1:], strict=False))
        for k in [*self.two, *self.three]:
            self.after[k[:-1]] = self.after.get(k[:-1], 0) + 1
        self.n, self.v = sum(self.one.values()), len(self.one)

    def p1(self, w):
        return (self.one[w] + 1) / (self.n + self.v + 1)

    def p2(self, c, w):
        if not self.one[c]:
            return self.p1(w)
        return max(0, self.two[c, w] - 0.75) / self.one[c] + 0.75 * self.after[c,] / self.one[c] * self.p1(w)

    def p3(self, b, c, w):
        if not self.two[b, c]:
            return self.p2(c, w)
        return max(0, self.three[b, c, w] - 0.75) / self.two[b, c] + 0.75 * self.after[b, c] / self.two[b, c] * self.p2(c, w)

    def score(self, text):
        w = tokens(text)
        return sum(math.log10(self.p2(b"\n", x) if i == 0 else self.p3(w[i - 2] if i > 1 else b"\n", w[i - 1], x)) for i, x in enumerate(w))


def test_the_plain_model_adds_up():
    m = Plain(["a b a b c", "b a c", "", "a"])
    for ctx in [(b"a", b"b"), (b"\n", b"a"), (b"b", b"a"), (b"x", b"a"), (b"x", b"y")]:
        assert sum(m.p3(*ctx, w) for w in m.one) + m.p3(*ctx, b"unknown") == pytest.approx(1)


def rows():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(60)], k=rng.randrange(0, 40))) for _ in range(300)]
    texts += [None, "", " \n", "W0 w0 W1", "é漢字 unseen words here", "x" * 3000, " ".join(rng.choices(vocabulary, k=20_000))] + [texts[3]] * 30
    return [*enumerate(texts), (3, texts[3]), (None, "w0 w1 w2")]


@pytest.mark.parametrize(("shard_bytes", "hot", "chunk"), [(16 << 20, 2_000_000, 400_000), (500, 300, 700), (1 << 14, 40, 5000)])
def test_against_exact_probabilities(spark, monkeypatch, shard_bytes, hot, chunk):
    """In one shard; in many, with words whose contexts are split, in small chunks."""
    monkeypatch.setattr(ngram, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(ngram, "HOT", hot)
    monkeypatch.setattr(ngram, "CHUNK", chunk)
    data = rows()
    got = ngram.fit_and_score(spark.createDataFrame([(i, t, 0.0, 1, "x") for i, t in data], SCHEMA).repartition(4)).collect()
    m = Plain([t for i, t in data if fold(i, 7) != 2])
    assert len(got) == len(data)
    of = dict(data)
    for r in got:
        w = tokens(of[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(m.one[x] > 0 for x in w), m.n, fold(r.doc_id, 7) == 2)
        assert r.base_score == pytest.approx(sum(math.log10(m.p1(x)) for x in w))
        assert r.score == pytest.approx(m.score(of[r.doc_id]), abs=0.051 * len(w))
    # rounding to 8 bits goes both ways, so over many words little is left of it
    whole = sum(r.n_tokens for r in got)
    assert sum(r.score - m.score(of[r.doc_id]) for r in got) == pytest.approx(0, abs=0.015 * whole)
    # bigrams and trigrams seen once count: held-out texts of the same source gain by them
    held = [r for r in got if r.held_out and r.n_tokens > 5]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_no_training_rows_and_empty(spark):
    only_held = [(i, "some words") for i in range(200) if fold(i, 7) == 2]
    got = ngram.fit_and_score(spark.createDataFrame([(i, t, 0.0, 1, "x") for i, t in only_held], SCHEMA)).collect()
    assert len(got) == len(only_held) and all(r.score == r.base_score == 0 and r.train_tokens == 0 for r in got)
    assert ngram.fit_and_score(spark.createDataFrame([], SCHEMA)).count() == 0


def test_packed_arrays():
    rng = np.random.default_rng(3)
    for n in (0, 1, 1000):
        arrays = [np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64)), rng.integers(0, 1 << 32, n, dtype=np.uint32)]
        back = ngram._unpacked(ngram._packed(arrays), [np.uint64, np.uint32])
        assert all((a == b).all() for a, b in zip(arrays, back, strict=True))


def test_successor_search():
    words = np.array([1, 4, 9, 2, 2 + 7, 30], np.uint32)
    got = ngram.successor(words, np.array([0, 0, 3, 3, 6, 0]), np.array([3, 3, 6, 6, 6, 0]), np.array([4, 5, 30, 1, 1, 1], np.uint32))
    assert got.tolist() == [1, -1, 5, -1, -1, -1]

"""The toxicity fit against a plain solver over all features, and a plain scorer; edge cases."""

import math
import random
import re

import numpy as np
import pytest

from quadloom.llm import toxicity

SCHEMA = "doc_id long, text string, toxic string, held_out string, score string, words int"


def objective(rows, labels, swaps, w, b, s):
    z = np.array([w[r].sum() + b for r in rows])
    loss = np.mean(np.logaddexp(0, z) - labels * z)
    change = np.array([w[a].sum() - w[c].sum() for a, c in swaps])
    return loss + s.l1 * np.abs(w).sum() + s.l2 / 2 * (w**2).sum() + s.counterfactual * (np.mean(change**2) if len(swaps) else 0)


def plain_fit(rows, labels, swaps, k, s):
    """Proximal gradient without momentum, working set or restarts, on dense matrices."""
    x = np.zeros((len(rows), k))
    for i, r in enumerate(rows):
        x[i, r] += 1
    d = np.zeros((max(1, len(swaps)), k))
    for i, (a, c) in enumerate(swaps):
        np.add.at(d[i], a, 1)
        np.add.at(d[i], c, -1)
    both = np.c_[x, np.ones(len(rows))]
    curve = np.linalg.norm(both, 2) ** 2 / 4 / len(rows) + 2 * s.counterfactual * np.linalg.norm(d, 2) ** 2 / len(d) + s.l2
    w, b = np.zeros(k), 0.0
    for _ in range(60_000):
        r = 1 / (1 + np.exp(-(x @ w + b))) - labels
        g = x.T @ r / len(rows) + s.l2 * w + 2 * s.counterfactual * d.T @ (d @ w) / len(d)
        w, b = w - g / curve, b - r.mean() / curve
        w = np.sign(w) * np.maximum(np.abs(w) - s.l1 / curve, 0)
    return w, b


@pytest.mark.parametrize("seed", range(3))
def test_working_set_finds_the_optimum_over_all_features(seed):
    rng = np.random.default_rng(seed)
    k, s = 300, toxicity.Settings(l1=2e-3, l2=1e-4, tolerance=1e-3)
    rows = [np.unique(rng.integers(0, k, 12)) for _ in range(200)]
    labels = np.array([float((r < 20).sum() > 0) if rng.random() < 0.9 else 0.0 for r in rows])
    swaps = [(np.unique(rng.integers(0, k, 4)), np.unique(rng.integers(0, k, 4))) for _ in range(15)]
    w, b = toxicity.fit_logistic(rows, labels, swaps, k, s)
    u, c = plain_fit(rows, labels, swaps, k, s)
    assert objective(rows, labels, swaps, w, b, s) <= objective(rows, labels, swaps, u, c, s) + 1e-5
    assert np.abs(w - u).max() < 0.1 and np.count_nonzero(w) > 5


def test_no_feature_and_no_sentence_is_left_out():
    settings = toxicity.Settings()
    text = ". ".join(f"the muslim number{chr(97 + i % 26)}{chr(97 + i // 26)} spoke" for i in range(200))
    words, pairs = toxicity.words_and_swaps(text, settings)
    assert len(pairs) == 200 and {"muslim", "spoke", "^mus", "^musl", "^musli", "numberaa"} <= {*words}
    left, right = pairs[0].split("|")
    assert "muslim" in left.split() and "muslim" not in right.split() and len({*right.split()} & {*toxicity.SWAPS["muslim"]}) == 1


def plain_score(model, text):
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    parts = {*words} | {"^" + w[:n] for w in words for n in (3, 4, 5) if len(w) > n}
    return 1 / (1 + math.exp(-(model.intercept + math.fsum(model.weights.get(p, 0) for p in parts))))


def test_scores_and_edge_cases(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("alpha beta gamma delta rotten vile".split()) if rng.random() < 0.2 else rng.choice("sun sea sand river".split()) for _ in range(30)) for _ in range(400)]
    rows = [(i, t) for i, t in enumerate(texts)]
    labels = [(i, int("vile" in t or "rotten" in t)) for i, t in rows]
    # repeated and contradicting labels, nulls, ids without a document, and values that are no label
    labels += [labels[0], (1, 1 - labels[1][1]), (None, 1), (3, None), (99_999, 1), (4, 7)]
    more = [(1000, None), (1001, ""), (1002, "  123 !!"), (1003, "vile " * 100_000), (None, "vile"), (5, texts[5])]
    docs = spark.createDataFrame([(i, t, "x", "y", "z", 1) for i, t in rows + more], SCHEMA)
    told = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, told)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) + len(more)
    of = dict(rows + more)
    for r in got:
        assert r.score == pytest.approx(plain_score(model, of[r.doc_id])) and r.predicted == int(r.score >= 0.3)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert len(held) > 60 and sum(r.predicted == int("vile" in of[r.doc_id] or "rotten" in of[r.doc_id]) for r in held) >= 0.97 * len(held)
    again = toxicity.fit(docs.repartition(7), told.repartition(2))
    assert again.weights.keys() == model.weights.keys() and all(again.weights[k] == pytest.approx(v, abs=0.02) for k, v in model.weights.items())
    assert toxicity.score(docs.where("false"), model).count() == 0
    nothing = toxicity.fit(docs.where("false"), told)
    assert nothing.weights == {} and all(r.predicted == 0 for r in toxicity.score(docs, nothing).collect())

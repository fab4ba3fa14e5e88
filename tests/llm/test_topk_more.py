"""Top-k against brute force: many blocks, ties across them, large components, and what the threshold passes over."""

import math
import random

import numpy as np
import pytest

from quadloom.llm import topk

SCHEMA = "vec_id long, embedding array<double>, score long, v array<long>"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, [2]) for i, v in rows], SCHEMA)


def brute(rows, queries, k=5):
    scaled = [(i, [max(topk.LEAST, min(topk.MOST, math.floor(256 * x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, u in scaled:
        if q in queries and q not in out:
            all_ = sorted((-max(topk.LEAST, min(topk.MOST, sum(a * b for a, b in zip(u, v, strict=True)))), i) for i, v in scaled if i != q and len(v) == len(u))
            if all_:
                out[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(all_[:k])]
    return out


def collected(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: sorted(rows) for q, rows in out.items()}


@pytest.mark.parametrize("scale", [0.3, 1e4, 1e7, 1e8, 1e15])
def test_every_magnitude(spark, scale):
    rng = random.Random(int(scale))
    rows = [(i, [rng.gauss(0, scale) for _ in range(7)]) for i in range(200)]
    rows += [(1000, [1e7, 3.0, 5.0, 0.0, 0.0, 0.0, 0.0]), (1001, [1e7, 3.0, 5.00390625, 0.0, 0.0, 0.0, 0.0]), (1002, [1e8] * 7), (1003, [-1e8] * 7)]
    df = frame(spark, rows)
    asked = {0, 50, 100, 150, 1000, 1002}
    assert collected(topk.top_k(df, df.where(df.vec_id.isin(asked)))) == brute(rows, asked)


def test_blocks_of_queries_and_rows(spark, monkeypatch):
    """Copies that tie lie in different blocks, tasks and query blocks; a third of all rows is one vector."""
    monkeypatch.setattr(topk, "ROWS", 16)
    monkeypatch.setattr(topk, "ABREAST", 8)
    rng = random.Random(4)
    vectors = [[rng.randrange(-4, 5) / 8 for _ in range(6)] for _ in range(40)]
    rows = [(rng.randrange(5000) * 2 + i % 2, vectors[0] if i % 3 == 0 else rng.choice(vectors)) for i in range(600)]
    rows += [(None, vectors[1]), (20_000, None), (20_001, [None] * 6), (20_002, [math.nan] * 6), (20_003, [math.inf] * 6), (20_004, []), (20_005, []), (20_006, [1.0])]
    df = frame(spark, rows).repartition(5)
    asked = {i for i, _ in rows if i is not None and i % 7 == 0} | {20_004, 20_006}
    few = df.where(df.vec_id.isin(asked)).dropDuplicates(["vec_id"])
    # a query id that repeats with other components counts once: take those whose rows agree
    same = {i for i in asked if len({tuple(v or ()) for j, v in rows if j == i}) == 1}
    got, want = collected(topk.top_k(df, few, block=6 * 8 * 10)), brute(rows, same)
    assert {q: got.get(q) for q in want} == want and 20_006 not in got
    assert got[20_004] == [(1, 20_005, 0)]


def test_fewer_rows_than_k_and_empty(spark):
    rows = [(1, [0.5, 1.0]), (2, [1.0, 1.0]), (3, [-2.0, 0.0])]
    df = frame(spark, rows)
    assert collected(topk.top_k(df, df)) == brute(rows, {1, 2, 3})
    assert topk.top_k(df.where("false"), df).count() == 0 and topk.top_k(df, df.where("false")).count() == 0


def test_the_threshold_leaves_rows_unread_and_unresolved():
    rng = np.random.default_rng(1)
    q = topk.Vectors(np.arange(4), rng.integers(-100, 100, (4, 32)))
    v = topk.Vectors(np.arange(100, 1100), rng.integers(-100, 100, (1000, 32)))
    whole = q.whole @ v.whole.T
    qi, vi, scores = topk.gathered(q, v, 5)
    assert len(qi) <= 4 * 5 * topk.LISTS and (scores == whole[qi, vi]).all()
    cutoff = np.array([np.sort(scores[qi == i])[-5] for i in range(4)])
    assert (cutoff <= np.sort(whole, axis=1)[:, -5]).all()
    qi, vi, scores = topk.sufficient(q, v, cutoff)
    assert {*zip(qi.tolist(), vi.tolist(), strict=True)} == {*zip(*(x.tolist() for x in np.nonzero(whole >= cutoff[:, None])), strict=True)}
    # lists that cannot reach their share are passed over, and the rest is exact all the same
    short = topk.Vectors(v.ids, np.where(np.arange(1000)[:, None] < 10, v.whole, v.whole // 50))
    for rows in (short, topk.Vectors(v.ids[10:], short.whole[10:])):
        qi, vi, scores = topk.sufficient(q, rows, cutoff)
        assert {*zip(qi.tolist(), vi.tolist(), strict=True)} == {*zip(*(x.tolist() for x in np.nonzero(q.whole @ rows.whole.T >= cutoff[:, None])), strict=True)}

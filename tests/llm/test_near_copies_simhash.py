"""The near-copy stage's fingerprints, bit-sliced comparison and keys against plain versions."""

import random

import corpus_pipeline
import numpy as np

from quadloom.llm import nearcopies
from tests.llm.test_near_copies import kept


def plain_fingerprint(own):
    bits = []
    for flip, factor in zip(nearcopies.FLIP.tolist(), nearcopies.FACTOR.tolist(), strict=True):
        hashes = []
        for h in own.tolist():
            h = ((h ^ flip) * factor) % (1 << 64)
            h = ((h ^ (h >> 32)) * factor) % (1 << 64)
            hashes.append(h ^ (h >> 29))
        bits.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    return bits


def test_fingerprints_are_majorities():
    for n in (4, 5, 30, 331):
        own = nearcopies.shingles(" ".join(f"w{i * i % 997}x{i}" for i in range(n + 4)))
        assert len(own) == n and nearcopies.fingerprint(own).tolist() == plain_fingerprint(own)


def test_bit_sliced_comparison():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 64, (30, 4), np.uint64)
    prints = np.concatenate([base] + [base ^ np.packbits(rng.random((30, 256)) < p, axis=1).view(np.uint64) for p in (0.0, 0.05, 0.15, 0.25, 0.27)])
    apart = prints[:, None] ^ prints[None]
    want = (np.bitwise_count(apart).sum(2) <= nearcopies.FAR) & (np.bitwise_count(apart[:, :, :2]).sum(2) <= nearcopies.HALF_FAR)
    got = np.zeros((len(prints), 192), bool)
    got[nearcopies.close(prints, nearcopies._planes(prints))] = True
    assert (got[:, : len(prints)] == want).all() and 300 < want.sum() < 0.2 * want.size


def test_pairs_of_a_key_are_all_pairs_of_two_labels(monkeypatch):
    monkeypatch.setattr(nearcopies, "STEP", 4)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 64, (1, 12), np.uint64)
    bits = np.repeat(base, 300, 0)
    bits[:, :4] ^= np.packbits(rng.random((300, 256)) < 0.11, axis=1).view(np.uint64)
    label, size = np.sort(rng.integers(0, 9, 300) * rng.integers(0, 2, 300)), np.full(300, 50)
    far = np.bitwise_count(bits[:, None, :4] ^ bits[None, :, :4])
    want = (far.sum(2) <= nearcopies.FAR) & (far[:, :, :2].sum(2) <= nearcopies.HALF_FAR) & (label[:, None] != label[None])
    got = [p for i, j in nearcopies.pairs_of_key(label, size, bits, np.zeros((0, 4), np.uint64)) for p in zip(i.tolist(), j.tolist(), strict=True)]
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i, j in zip(*(x.tolist() for x in np.nonzero(want)), strict=True) if i < j}


def test_near_copies_go_by_keys(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "ALONE", 0)
    assert len(nearcopies.tables(1)) > 2 * nearcopies.STARS
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    texts = []
    for _ in range(30):
        base = [word() for _ in range(rng.randrange(40, 200))]
        for n in (0, 1, 3, 5, 8):
            texts.append(" ".join(word() if i in rng.sample(range(len(base)), n) else w for i, w in enumerate(base)))
    hot = [word() for _ in range(120)]
    texts += [" ".join(hot[:i] + [word()] + hot[i + 1 :]) for i in range(100)]
    for _ in range(60):  # four shingles in five, the smallest sets that are near copies without being equal
        few = [word() for _ in range(9)]
        texts += [" ".join(few), " ".join(few[:8]), " ".join(few[:7])]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert got == kept(rows)


def test_nearest_of_a_key(monkeypatch):
    monkeypatch.setattr(nearcopies, "STEP", 4)
    rng = np.random.default_rng(6)
    bits = np.repeat(rng.integers(0, 1 << 64, (1, 12), np.uint64), 300, 0)
    bits[:, :4] ^= np.packbits(rng.random((300, 256)) < 0.11, axis=1).view(np.uint64)
    label, size = np.sort(rng.integers(0, 9, 300) * rng.integers(0, 2, 300)), np.full(300, 50)
    far = np.bitwise_count(bits[:, None, :4] ^ bits[None, :, :4])
    good = (far.sum(2) <= nearcopies.FAR) & (far[:, :, :2].sum(2) <= nearcopies.HALF_FAR) & (label[:, None] != label[None])
    least = np.where(good, far.sum(2, dtype=np.int64), 999).min(1)
    i, j, d = nearcopies.nearest_of_key(label, size, bits)
    assert i.tolist() == np.flatnonzero(least < 999).tolist() and d.tolist() == least[i].tolist()
    assert good[i, j].all() and (far.sum(2)[i, j] == d).all()


def test_pairs_grow_with_the_sets_and_not_with_the_square_of_a_group(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "ALONE", 0)
    counts, own = [], nearcopies.candidates

    def counted(*args):
        pairs = own(*args)
        counts.append(pairs.count())
        return pairs

    monkeypatch.setattr(nearcopies, "candidates", counted)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    now, texts = [word() for _ in range(1500)], []
    for at in rng.sample(range(1500), 300):  # each is a near copy of some 30 before it, and of no more
        now[at] = word()
        texts.append(" ".join(now))
    texts += [" ".join(word() for _ in range(200)) for _ in range(100)]
    rows = list(enumerate(texts))
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert got == {0, *range(300, 400)}
    assert max(counts) <= 2 * 300


def test_sets_far_from_all_others_go_to_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "ALONE", 0)
    seen, own = [], nearcopies.candidates
    monkeypatch.setattr(nearcopies, "candidates", lambda sets, *args: seen.append(sets.count()) or own(sets, *args))
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    texts = [" ".join(word() for _ in range(150)) for _ in range(200)]
    rows = list(enumerate(texts + [t + " end" for t in texts[:20]]))
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert got == set(range(200)) and set(seen) == {40}

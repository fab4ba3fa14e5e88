"""The pipeline's near-copy stage against brute-force Jaccard similarity."""

import random

import corpus_pipeline


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept(rows):
    """Smallest id of each component over all pairs."""
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return {rows[i][0] for i in range(len(rows)) if root(i) == i}


def test_near_copies_go(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    texts = ["", None, " \n", "two words", "Two  words", "two word"]
    for _ in range(40):
        base = [word() for _ in range(rng.randrange(40, 200))]
        texts.append(" ".join(base))
        for _ in range(3):  # 0 to 8 changed words, so similarities on both sides of 0.8
            other = list(base)
            for at in rng.sample(range(len(base)), rng.randrange(9)):
                other[at] = word()
            texts.append(" ".join(other))
    chain = [word() for _ in range(60)]
    for _ in range(40):  # a long chain of near copies whose ends have nothing in common
        texts.append(" ".join(chain))
        chain = [*chain[3:], *[word() for _ in range(3)]]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame([*rows, rows[7], (None, rows[9][1]), (None, "only here, without an id"), (None, "only here, without an id")], "doc_id long, text string")
    got = [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()]
    assert sorted(i for i in got if i is not None) == sorted(kept(rows))
    assert got.count(None) == 1

"""Toxicity: a counterfactual-regularised linear classifier over the words of whole texts."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadloom.llm.common import drop_path, map_arrow, materialise, remainder

#: Identity terms that may be swapped for each other, by category (fixed values).
IDENTITIES = {
    "religion": "muslim christian jewish hindu buddhist sikh catholic atheist",
    "religion, plural": "muslims christians jews hindus buddhists sikhs catholics atheists",
    "gender": "woman man female male transgender nonbinary",
    "gender, plural": "women men females males",
    "orientation": "gay straight lesbian bisexual homosexual heterosexual queer",
    "origin": "african american asian european mexican chinese arab indian latino",
    "origin, plural": "africans americans asians europeans mexicans arabs indians latinos immigrants",
    "colour": "black white brown",
    "ability": "deaf blind disabled autistic paralyzed",
    "age": "old young elderly teenage",
    "es": "mujer hombre musulmán cristiano judío negro blanco gay",
    "fr": "femme homme musulman chrétien juif noir blanc gay",
    "de": "frau mann muslim christ jude schwarzer weißer schwuler",
}
SWAPS = {term: sorted({*terms.split()} - {term}) for terms in IDENTITIES.values() for term in terms.split()}
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]+")


@dataclass(frozen=True)
class Settings:
    """rows bounds the fit: so many labelled rows, chosen by a hash of their ids, with all their features and sentences.
    slots: numbers that features get by a hash; of a million features some six in a hundred share theirs with another.
    Features are words and, as slurs are inflected and compounded, the beginnings of words in so many letters. The fit
    ends when its steps are within tolerance * l1, or after so many steps for a working set."""

    rows: int = 16_384
    slots: int = 1 << 24
    prefixes: tuple[int, ...] = (3, 4, 5)
    l1: float = 2e-4
    l2: float = 1e-6
    counterfactual: float = 1.0
    steps: int = 3000
    tolerance: float = 0.05
    threshold: float = 0.3


def features(words: list[str], prefixes: tuple[int, ...]) -> set[str]:
    """The words, and the beginnings of those that are longer, marked as such."""
    out = {*words}
    longer = list(out)
    for n in prefixes:
        out |= {"^" + w[:n] for w in longer if len(w) > n}
    return out


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    intercept: float
    threshold: float
    prefixes: tuple[int, ...] = ()

    def score(self, text: str | None) -> float:
        found = self.weights.keys() & features(WORD.findall((text or "").lower()), self.prefixes)
        return float(1 / (1 + np.exp(-(self.intercept + sum(self.weights[w] for w in sorted(found))))))


def words_and_swaps(text: str | None, settings: Settings) -> tuple[list[str], list[str]]:
    """Distinct features, and for sentences with an identity term 'sentence features|swapped sentence features'."""
    text = (text or "").lower()
    found = WORD.findall(text)
    words, pairs = {*found}, []
    joined = lambda own: " ".join(sorted(features(own, settings.prefixes)))
    if words & SWAPS.keys():
        for sentence in SENTENCE.split(text):
            own = WORD.findall(sentence)
            for term in sorted({*own} & SWAPS.keys()):
                other = SWAPS[term][len(own) % len(SWAPS[term])]
                pairs.append(joined(own) + "|" + joined([other if w == term else w for w in own]))
    return sorted(features(found, settings.prefixes)), pairs


def sample(labelled: DataFrame, settings: Settings) -> DataFrame:
    """(toxic, words, pairs) of at most ``settings.rows`` labelled texts, chosen by a hash of their ids."""
    schema = T.StructType([T.StructField("toxic", T.IntegerType()), T.StructField("words", T.ArrayType(T.StringType())), T.StructField("pairs", T.ArrayType(T.StringType()))])

    def each(batch):
        both = [words_and_swaps(t, settings) for t in batch.column(1).to_pylist()]
        return {"toxic": batch.column(0), "words": [w for w, _ in both], "pairs": [p for _, p in both]}

    return map_arrow(labelled.select("toxic", "text"), each, schema)


class Sparse:
    """Ones at (row, column), or +1 and -1, of a matrix with so many rows and columns; worked through in steps of STEP."""

    STEP = 1 << 20

    def __init__(self, row: np.ndarray, column: np.ndarray, sign: np.ndarray | None, rows: int, columns: int):
        self.row, self.column, self.sign, self.shape = row, column, sign, (rows, columns)

    def _product(self, to: np.ndarray, of: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(n)
        for at in range(0, len(to), self.STEP):
            part = slice(at, at + self.STEP)
            own = v[of[part]]
            out += np.bincount(to[part], own if self.sign is None else own * self.sign[part], n)
        return out

    def __matmul__(self, v: np.ndarray) -> np.ndarray:
        return self._product(self.row, self.column, v, self.shape[0])

    def transposed(self, v: np.ndarray) -> np.ndarray:
        return self._product(self.column, self.row, v, self.shape[1])

    def columns(self, chosen: np.ndarray) -> Sparse:
        place = np.full(self.shape[1], -1, np.int32)
        place[chosen] = np.arange(len(chosen), dtype=np.int32)
        own = place[self.column]
        keep = own >= 0
        return Sparse(self.row[keep], own[keep], None if self.sign is None else self.sign[keep], self.shape[0], len(chosen))


def _gradient(x: Sparse, d: Sparse, labels: np.ndarray, w: np.ndarray, b: float, settings: Settings) -> tuple[np.ndarray, float]:
    n, m = max(1, x.shape[0]), max(1, d.shape[0])
    r = 1 / (1 + np.exp(-(x @ w + b))) - labels
    return x.transposed(r) / n + settings.l2 * w + 2 * settings.counterfactual / m * d.transposed(d @ w), float(r.sum() / n)


def _solve(x: Sparse, d: Sparse, labels: np.ndarray, w: np.ndarray, b: float, settings: Settings) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient from (w, b), restarted when a step turns back, until the steps are small against l1."""
    n, m, k = max(1, x.shape[0]), max(1, d.shape[0]), len(w)
    # the step: inverse of a bound on the curvature, found by power iteration
    v, top = np.ones(k + 1) / np.sqrt(k + 1), 1.0
    for _ in range(30):
        z = x @ v[:k] + v[-1]
        u = np.r_[x.transposed(z), z.sum()] / (4 * n)
        u[:k] += 2 * settings.counterfactual / m * d.transposed(d @ v[:k])
        top = float(np.linalg.norm(u)) or 1.0
        v = u / top
    step = 1 / (1.1 * top + settings.l2)
    yw, yb, t = w, b, 1.0
    for _ in range(settings.steps):
        gw, gb = _gradient(x, d, labels, yw, yb, settings)
        after, bias = yw - step * gw, yb - step * gb
        after = np.sign(after) * np.maximum(np.abs(after) - step * settings.l1, 0)
        if (yw - after) @ (after - w) + (yb - bias) * (bias - b) > 0:
            t = 1.0
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        moved = max(float(np.abs(after - yw).max(initial=0)), abs(bias - yb)) / step
        yw, yb = after + (t - 1) / later * (after - w), bias + (t - 1) / later * (bias - b)
        w, b, t = after, bias, later
        if moved < settings.tolerance * settings.l1:
            break
    return w, b


def lists(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(values, lengths) of a list of arrays, as fit_logistic takes them."""
    return np.concatenate([*parts, np.zeros(0, np.int32)]).astype(np.int32), np.array([len(p) for p in parts], np.int64)


def fit_logistic(rows: list[np.ndarray] | tuple, labels: np.ndarray, swaps: list[tuple[np.ndarray, np.ndarray]] | tuple, k: int, settings: Settings) -> tuple[np.ndarray, float]:
    """Weights of all k features and the intercept, from each row's features and each swap's two sides (or the lists() of
    rows, and of the sides in turn): log loss + l1 + l2 + counterfactual * mean (score change)^2.

    The score change of a swap is that of the log odds, w . (x - x'), so the penalty is convex. Solved on a
    working set: features whose gradient at weight zero exceeds l1 join it until no feature is left that
    would, so the answer is that of all features and none is left out beforehand.
    """
    values, lengths = rows if isinstance(rows, tuple) else lists(rows)
    x = Sparse(np.repeat(np.arange(len(lengths), dtype=np.int32), lengths), values, None, len(lengths), k)
    values, lengths = swaps if isinstance(swaps, tuple) else lists([half for pair in swaps for half in pair])
    side = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    d = Sparse(side // 2, values, np.where(side % 2 == 0, 1.0, -1.0), len(lengths) // 2, k)
    rate = float(np.clip(labels.mean() if len(labels) else 0.0, 1e-3, 1 - 1e-3))
    w, b = np.zeros(k), float(np.log(rate / (1 - rate)))
    chosen = np.zeros(0, int)
    while True:
        pull = np.abs(_gradient(x, d, labels, w, b, settings)[0])
        pull[chosen] = 0
        # the strongest first, as they may speak for the others
        more = np.flatnonzero(pull > 1.01 * settings.l1)
        if not len(more) and len(chosen):
            return w, b
        chosen = np.sort(np.r_[chosen, more[np.argsort(-pull[more], kind="stable")[: max(64, len(chosen) // 2)]]])
        own, b = _solve(x.columns(chosen), d.columns(chosen), labels, w[chosen], b, settings)
        w = np.zeros(k)
        w[chosen] = own
        if not len(more):
            return w, b


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Learns from rows with a 0/1 label whose crc32(doc_id) mod 4 is not 2, settings.rows of them at most, with all their words.

    What reaches the driver is those rows as numbers of features; the documents are read once. Labels of
    one id that contradict each other count once, as toxic; rows that repeat a doc_id each count. Null ids
    and labels are left out. No usable labels, or an empty table: every score is the prior, 0.001.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), 4) != 2)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    # at most settings.rows ids and labels, so the broadcast is bounded; a doubled label counts once, as toxic
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.rows)
    rows, path = materialise(sample(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text"), settings), "toxicity-sample")
    # features are numbered by a hash, so no task and no driver holds their names
    number = lambda w: F.pmod(F.xxhash64(w), F.lit(settings.slots)).cast("int")
    halves = F.flatten(F.transform("pairs", lambda p: F.transform(F.split(p, r"\|"), lambda h: F.filter(F.split(h, " "), lambda w: w != ""))))
    numbered = rows.select("toxic", F.transform("words", number).alias("ids"), halves.alias("halves"))
    numbered = numbered.select("toxic", "ids", F.transform("halves", F.size).alias("sizes"), F.transform(F.flatten("halves"), number).alias("swaps"))
    got = numbered.toArrow()
    flat = lambda name: np.concatenate([*[c.flatten().to_numpy(zero_copy_only=False) for c in got.column(name).chunks], np.zeros(0, np.int32)]).astype(np.int32)
    lengths = np.concatenate([*[np.diff(c.offsets.to_numpy()) for c in got.column("ids").chunks], np.zeros(0, np.int64)]).astype(np.int64)
    ids, swaps, sizes, toxic = flat("ids"), flat("swaps"), flat("sizes"), got.column("toxic").to_numpy().astype(float)
    del got
    # the slots in use, one after the other; a swapped word that no row has keeps weight zero
    used = np.zeros(settings.slots, bool)
    used[ids] = used[swaps] = True
    place = np.cumsum(used, dtype=np.int32) - 1
    w, b = fit_logistic((place[ids], lengths), toxic, (place[swaps], sizes), int(used.sum()), settings)
    weights = dict(zip(np.flatnonzero(used)[w != 0].tolist(), w[w != 0].tolist(), strict=True))
    # the names of the features with a weight, which are few
    names = rows.select(F.explode("words").alias("word")).where(number(F.col("word")).isin(list(weights))).distinct().select("word", number(F.col("word"))).collect() if weights else []
    drop_path(docs.sparkSession, path)
    return Model({r[0]: weights[r[1]] for r in names}, b, settings.threshold, settings.prefixes)


def score_column(model: Model, text: Column) -> Column:
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return score(text)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted; one row per input row, of the whole text. Null, empty and wordless texts get the
    intercept's score. Repeated rows are scored alike; other columns are ignored. An empty table: no rows."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), score_column(model, F.col("text")).alias("score")).withColumn("predicted", (F.col("score") >= model.threshold).cast("int"))

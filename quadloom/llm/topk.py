"""Exact top-k inner products by a three-phase uniform threshold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadloom.llm.common import drop_path, materialise, new_path

K, LISTS, ROWS, ABREAST = 5, 4, 2048, 256
#: Bytes of the components of a block of queries, which goes to all tasks.
BLOCK = 16 << 20
LEAST, MOST = -(1 << 63), (1 << 63) - 1
LOCAL = T.StructType([T.StructField(c, T.LongType()) for c in ("query_id", "vec_id", "score")])


def quantised(embedding: Column) -> Column:
    """floor(256 x) of each component, held at the ends of 64 bits; null if the vector or a component is null or not finite."""
    values = F.transform(embedding, lambda x: x.cast("double"))
    odd = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(embedding.isNotNull() & ~odd, F.transform(values, lambda x: F.floor(x * 256).cast("long")))


class Vectors:
    """Integer vectors of one length, cut into LISTS slices, in which their inner products make a list of scores each."""

    def __init__(self, ids: np.ndarray, whole: np.ndarray):
        self.ids, self.whole = ids, whole
        width = whole.shape[1]
        self.slices = [slice(int(p[0]), int(p[-1]) + 1) if len(p) else slice(0, 0) for p in np.array_split(np.arange(width), min(LISTS, max(1, width)))]
        self.parts = [whole[:, s].astype(np.float64) for s in self.slices]
        self.norms = [np.sqrt(np.einsum("ij,ij->i", p, p)) for p in self.parts]
        self.peak = max(abs(int(whole.min(initial=0))), abs(int(whole.max(initial=0))))

    def __getitem__(self, rows: slice) -> Vectors:
        return Vectors(self.ids[rows], self.whole[rows])


def resolve(q: Vectors, v: Vectors, qi: np.ndarray, vi: np.ndarray) -> np.ndarray:
    """Exact inner products of the pairs, held at the ends of 64 bits."""
    if q.peak * v.peak * q.whole.shape[1] <= MOST:
        parts = [np.einsum("ij,ij->i", q.whole[qi[at : at + 65_536]], v.whole[vi[at : at + 65_536]]) for at in range(0, len(qi), 65_536)]
        return np.concatenate([*parts, np.zeros(0, np.int64)])
    whole = (sum(a * b for a, b in zip(q.whole[i].tolist(), v.whole[j].tolist(), strict=True)) for i, j in zip(qi.tolist(), vi.tolist(), strict=True))
    return np.fromiter((min(MOST, max(LEAST, x)) for x in whole), np.int64, len(qi))


def error(q: Vectors, v: Vectors) -> list[float]:
    """What an entry of each list may be off by, as it is computed in doubles: nothing below 2^53."""
    if q.peak * v.peak * q.whole.shape[1] <= 1 << 53:
        return [0.0] * len(q.parts)
    return [(p.shape[1] + 4) * 2.0**-52 * float(a.max(initial=0)) * float(b.max(initial=0)) for p, a, b in zip(q.parts, q.norms, v.norms, strict=True)]


def best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores of each query, ties to the smaller id."""
    order = np.lexsort((ids, ~scores, query))
    own = query[order]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])[: len(own)]
    place = np.arange(len(own)) - np.repeat(first, np.diff(np.r_[first, len(own)]))
    return order[place < k]


def gathered(q: Vectors, v: Vectors, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phase 1: the k best entries of each list, as (query, row, whole score); the lists are in no way added up for other rows."""
    lists = [a @ b.T for a, b in zip(q.parts, v.parts, strict=True)]
    mine = q.ids[:, None] == v.ids[None, :]
    top = min(k, len(v.ids))
    chosen = np.zeros(mine.shape, bool)
    for scores in lists:
        np.put_along_axis(chosen, np.argpartition(np.where(mine, -np.inf, scores), len(v.ids) - top, axis=1)[:, len(v.ids) - top :], True, axis=1)
    qi, vi = np.nonzero(chosen & ~mine)
    if any(error(q, v)):
        return qi, vi, resolve(q, v, qi, vi)
    return qi, vi, sum(x[qi, vi] for x in lists).astype(np.int64)


def sufficient(q: Vectors, v: Vectors, cutoff: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phases 2 and 3: (query, row, whole score) of all rows that reach the query's cutoff.

    The lists add up to the cutoff at least, so one of them holds its uniform share of it: only entries
    from that share on are read. A list whose longest vectors cannot reach the share is passed over. Of
    the rows read those are left out that cannot reach the cutoff if their other entries are just below
    the share, and the rest are resolved.
    """
    off = error(q, v)
    told = np.where(cutoff > LEAST, cutoff.astype(np.float64), -np.inf)
    share = told / len(q.parts)
    slack = np.where(np.isinf(share), 0, np.abs(share)) * 2.0**-50
    read, most, lists, passed = np.zeros((len(q.ids), len(v.ids)), bool), np.zeros((len(q.ids), len(v.ids))), [], False
    for a, b, na, nb, e in zip(q.parts, v.parts, q.norms, v.norms, off, strict=True):
        low = share - slack - e
        live = na * nb.max(initial=0) * (1 + 2.0**-40) >= low
        if live.all():
            scores = a @ b.T
        else:
            passed = True
            scores = np.full(read.shape, -np.inf)
            scores[live] = a[live] @ b.T
        over = scores >= low[:, None]
        read |= over
        most += np.where(over, scores + e, share[:, None])
        lists.append(scores)
    qi, vi = np.nonzero(read & (most >= (told - slack * len(lists) * 4)[:, None]) & (q.ids[:, None] != v.ids[None, :]))
    scores = resolve(q, v, qi, vi) if passed or any(off) else sum(x[qi, vi] for x in lists).astype(np.int64)
    keep = scores >= cutoff[qi]
    return qi[keep], vi[keep], scores[keep]


def _phase(rows: DataFrame, query_ids: np.ndarray, queries: np.ndarray, k: int, cutoff: np.ndarray | None) -> DataFrame:
    """(query_id, vec_id, score): the best k of a task for each query, without a cutoff among the gathered rows (whose
    ids are left out, as only their scores matter), with it among the sufficient ones."""
    width = queries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = Vectors(query_ids, queries)
        blocks = [(at, asked[at : at + ABREAST]) for at in range(0, len(query_ids), ABREAST)]
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def compact() -> tuple[np.ndarray, ...]:
            q, ids, scores = (np.concatenate([h[i] for h in held]) if held else np.zeros(0, np.int64) for i in range(3))
            at = best(q, ids, scores, k)
            return q[at], ids[at], scores[at]

        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                own = Vectors(batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width))
                for at, q in blocks:
                    qi, vi, scores = gathered(q, own, k) if cutoff is None else sufficient(q, own, cutoff[at : at + ABREAST])
                    if len(qi):
                        keep = best(qi, own.ids[vi], scores, k)
                        held.append((qi[keep] + at, own.ids[vi[keep]], scores[keep]))
                        size += len(keep)
                if size > max(100_000, 4 * k * len(query_ids)):
                    held = [compact()]
                    size = len(held[0][0])
        q, ids, scores = compact()
        yield pa.RecordBatch.from_arrays([pa.array(query_ids[q]), pa.array(ids if cutoff is not None else np.zeros(len(q), np.int64)), pa.array(scores)], ["query_id", "vec_id", "score"])

    return rows.mapInArrow(run, LOCAL)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for every query (vec_id, embedding) its k best rows of vectors by integer inner product.

    The components are cut into slices; each slice makes a list of scores. Phase 1 gathers, in every
    block of rows, the k best entries of each list and their whole scores; the k-th of these is a safe
    cutoff. Phase 2 broadcasts the cutoffs and reads the entries from the uniform share of the cutoff on;
    phase 3 resolves the whole scores of the rows that may reach it, in integers. Lists are computed in
    doubles with a bound on their error, so that rounding loses nothing. Rows lie by length, so that
    blocks of short vectors are passed over. A task gives k rows a query at most, ties to the smaller
    vec_id, so copies of one vector never pile up.

    Queries go in blocks of ``block`` bytes, of which one at a time passes through the driver to all
    tasks; each block reads the rows twice and appends to one table of answers. A query is compared with
    vectors of its own length. Its own vec_id takes no part, in any row that repeats it; other ids that
    repeat are rows of their own; a query id given twice counts once. Invalid vectors and null ids take
    no part. Fewer than k rows: all of them. Empty tables: no rows. Components beyond 64 bits after
    scaling, and scores beyond them, are held at the ends of that range. Other columns are ignored.
    """
    spark = vectors.sparkSession
    valid = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("v")).where("vec_id is not null and v is not null").withColumn("width", F.size("v"))
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    rows, rows_path = materialise(valid(vectors).withColumn("length", length).sortWithinPartitions("width", F.col("length").desc()).drop("length"), "topk-rows")
    asked, asked_path = materialise(valid(queries).dropDuplicates(["vec_id"]), "topk-queries")
    answers = new_path(spark, "topk-answers")
    spark.createDataFrame([], "query_id long, vec_id long, score long, rank int").write.parquet(answers)
    for width, n in sorted((r.width, r.n) for r in asked.groupBy("width").agg(F.count("*").alias("n")).collect()):
        mine = rows.where(F.col("width") == width).select("vec_id", "v")
        blocks = -(-n * max(1, width) * 8 // block)
        for nth in range(blocks):
            some = asked.where((F.col("width") == width) & (F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == nth)).select("vec_id", "v").toArrow().combine_chunks()
            if not some.num_rows:
                continue
            ids = some.column("vec_id").to_numpy()
            matrix = some.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), width)
            first = _ranked(_phase(mine, ids, matrix, k, None), k).groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).collect()
            least = {r.query_id: r.least for r in first if r.n == k}
            cutoff = np.array([least.get(i, LEAST) for i in ids.tolist()], np.int64)
            _ranked(_phase(mine, ids, matrix, k, cutoff), k).select("query_id", "vec_id", "score", "rank").write.mode("append").parquet(answers)
    for path in (rows_path, asked_path):
        drop_path(spark, path)
    return spark.read.schema("query_id long, vec_id long, score long, rank int").parquet(answers).select("query_id", "rank", "vec_id", "score")

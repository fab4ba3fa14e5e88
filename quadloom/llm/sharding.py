"""Sharding by vector bin packing over bytes, tokens and rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadloom.llm.common import materialise

EMPTY_CRC = 0


@dataclass(frozen=True)
class Settings:
    """bundles: groups of equal texts that are small are packed in so many bundles, by hash, whatever the input's size.
    pieces: a group of over 1/pieces of a shard (of its bytes, tokens or rows) is an item of its own, numbered in pieces."""

    shards: int = 24
    bundles: int = 16_384
    pieces: int = 32


def pack(vectors: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item (rows: bytes, tokens, rows): the largest item first, to the shard where its dot product with the residual capacity is highest."""
    share = vectors / np.maximum(vectors.sum(0), 1)
    residual = np.full((shards, vectors.shape[1]), 1 / shards)
    out = np.zeros(len(vectors), np.int64)
    for i in np.lexsort((np.arange(len(share)), -share.max(1))):
        # in a full shard every residual is negative; the highest product is then the least overfull one
        out[i] = best = int(np.argmax(residual @ share[i]))
        residual[best] -= share[i]
    return out


def shard(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null), tokens; one row per input row.

    Equal texts (by their XXH64, CRC-32 and length) form a group and stay in one shard, but for a group
    that is more than a whole shard's share of the bytes, tokens or rows: no shard can hold it, so it is
    dealt out in pieces. Other groups of over 1/pieces of a shard are placed one by one, the small ones
    in bundles of whole groups. Only the vectors of these items reach the driver: bundles and
    3 * shards * pieces groups and twice as many pieces at most, whatever the input's size. Slots are
    offsets of pieces plus the place in the piece, so no task sorts a whole shard or a large group.

    Null text: size 8, crc 0, grouped with the other nulls. Repeated rows, also with one doc_id, are rows
    of their own, spread over the pieces of their group; which of them gets which slot is undefined. An
    empty table: no rows. Long texts are measured whole. Other columns are ignored, whatever their names.
    """
    data = F.col("text").cast("binary")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    measured, _ = materialise(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            size.alias("size"),
            F.coalesce(F.crc32(data), F.lit(EMPTY_CRC)).cast("long").alias("text_crc32"),
            F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)).cast("long").alias("tokens"),
            F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull()).alias("h"),
            F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(1 << 30)).cast("int").alias("salt"),
        ),
        "shard-measured",
    )
    spark = docs.sparkSession
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    group = ["h", "text_crc32", "size"]
    total = measured.agg(*sums).first()
    share = F.greatest(*[F.col(c) / max(1, total[c] or 0) for c in ("bytes", "tokens", "rows")])
    least = 1 / (settings.shards * settings.pieces)
    large = measured.groupBy(*group).agg(*sums).withColumn("share", share).where(F.col("share") > least).orderBy(*group).collect()
    own = [(r.h, r.text_crc32, r["size"], settings.bundles + i, -int(-r.share // least)) for i, r in enumerate(large)]
    bundle = F.pmod("h", F.lit(settings.bundles)).cast("int")
    numbered = measured.join(F.broadcast(spark.createDataFrame(own, "h long, text_crc32 long, size long, own int, parts int")), group, "left")
    placed = numbered.select("doc_id", "size", "text_crc32", "tokens", F.coalesce("own", bundle).alias("bundle"), F.pmod("salt", F.coalesce("parts", F.lit(1))).alias("piece"))
    pieces = placed.groupBy("bundle", "piece").agg(*sums).orderBy("bundle", "piece").collect()
    # an item: a bundle, a group, or a piece of a group that no shard can hold
    split = {settings.bundles + i for i, r in enumerate(large) if r.share > 1 / settings.shards}
    item: dict[tuple[int, int], int] = {}
    of = np.array([item.setdefault((r.bundle, r.piece if r.bundle in split else 0), len(item)) for r in pieces], int)
    vectors = np.zeros((len(item), 3))
    np.add.at(vectors, of, np.array([(r.bytes, r.tokens, r.rows) for r in pieces], float).reshape(-1, 3))
    where, offset, rows = pack(vectors, settings.shards)[of], [0] * settings.shards, []
    for r, s in zip(pieces, where.tolist(), strict=True):
        rows.append((r.bundle, r.piece, s, offset[s]))
        offset[s] += r.rows
    plan = spark.createDataFrame(rows, "bundle int, piece int, shard int, start long")
    spot = F.row_number().over(Window.partitionBy("bundle", "piece").orderBy("doc_id", "text_crc32"))
    return placed.withColumn("spot", spot).join(F.broadcast(plan), ["bundle", "piece"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("spot") - 1).alias("slot"), F.lit(None).cast(T.IntegerType()).alias("grown_shard"), "tokens"
    )


def write_shards(docs: DataFrame, path: str, settings: Settings = Settings()) -> None:
    """Writes the rows of docs, which need distinct ids, to path/shard=N, each with its slot."""
    docs.join(shard(docs, settings).select("doc_id", "shard", "slot"), "doc_id").write.partitionBy("shard").parquet(path)

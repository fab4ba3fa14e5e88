"""SimHash near-dedup: bit-sliced Hamming comparison of 64-bit fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadloom.llm.common import drop_path, map_arrow, materialise
from quadloom.llm.components import connected_components

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Members of a key that one comparison takes; larger keys are refined, down to 8 free bits and so 256 values.
BUCKET = 256
ALL = (1 << 64) - 1


def fingerprint(text: str | None) -> int:
    """Majority bits of the XXH64 of all word shingles; zero for null and for texts without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    n = len(words) - SHINGLE + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)), repeat(SEED)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        counts += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def bit_planes(values: np.ndarray) -> np.ndarray:
    """Plane b holds bit b of all values, 64 values to a word; the last word is padded with zeros."""
    bits = np.zeros((-(-len(values) // 64) * 64, 64), np.uint8)
    bits[: len(values)] = np.unpackbits(np.ascontiguousarray(values, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def within(differences: Iterator[np.ndarray], shape: tuple[int, int], radius: int) -> np.ndarray:
    """Bit set where at most ``radius`` (0 to 3) of the given difference planes have a bit.

    ``differences(rows)`` gives the next plane of the blocks (rows) still alive. Two carry-save counter
    planes and an overflow plane count 64 distances per word; a block whose distances all exceed the
    radius is abandoned and takes no part in later planes.
    """
    alive = np.arange(shape[0])
    ones, twos, over = (np.zeros(shape, np.uint64) for _ in range(3))
    out = np.zeros(shape, np.uint64)
    exceeded = {0: lambda: ones | twos | over, 1: lambda: twos | over, 2: lambda: ones & twos | over, 3: lambda: over}[radius]
    for step, plane in enumerate(differences, 1):
        plane = plane(alive)
        carry = ones & plane
        ones ^= plane
        over |= twos & carry
        twos ^= carry
        if step % 8 == 0:
            keep = ~(exceeded() == np.uint64(ALL)).all(axis=1)
            if not keep.all():
                alive, ones, twos, over = alive[keep], ones[keep], twos[keep], over[keep]
                if not len(alive):
                    return out
    out[alive] = ~exceeded()
    return out


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which a[i], b[i] differ in at most ``radius`` bits; blocks of 8 words of 64 pairs."""
    planes = bit_planes(a ^ b)
    width = -(-planes.shape[1] // 8) * 8
    planes = np.pad(planes, ((0, 0), (0, width - planes.shape[1])), constant_values=ALL).reshape(64, -1, 8)
    found = within((lambda rows, p=p: p[rows] for p in planes), planes.shape[1:], radius)
    return np.unpackbits(found.reshape(-1).view(np.uint8), bitorder="little")[: len(a)].astype(bool)


def close_matrix(values: np.ndarray, radius: int) -> np.ndarray:
    """Square boolean matrix of values that differ in at most ``radius`` bits: each query against all planes."""
    planes, n = bit_planes(values), len(values)
    flips = np.where(np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool), np.uint64(ALL), np.uint64(0))
    found = within((lambda rows, b=b: planes[b][None, :] ^ flips[rows, b][:, None] for b in range(64)), (n, planes.shape[1]), radius)
    return np.unpackbits(found.view(np.uint8).reshape(n, -1), axis=1, bitorder="little")[:, :n].astype(bool)


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index that each of n items reaches over the links a-b."""
    label = np.arange(n)
    while len(a):
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def links_in_keys(key: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (index, index of the smallest member) among values of equal key; keys are adjacent.

    Keys of up to 32 members are compared together, offset by offset; larger ones each as a matrix.
    """
    n = len(values)
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if n else np.zeros(0, int)
    length = np.diff(np.r_[start, n])
    end = np.repeat(start + length, length)
    short = np.repeat(length <= 32, length)
    a, b = [], []
    for d in range(1, min(32, int(length.max(initial=0)))):
        i = np.flatnonzero(short & (np.arange(n) + d < end))
        if not len(i):
            break
        i = i[close_pairs(values[i], values[i + d], radius)]
        a.append(i)
        b.append(i + d)
    for s, m in zip(start[length > 32], length[length > 32], strict=True):
        i, j = np.nonzero(np.triu(close_matrix(np.ascontiguousarray(values[s : s + m]), radius), 1))
        a.append(i + s)
        b.append(j + s)
    label = _labels(n, *(np.concatenate(x) if x else np.zeros(0, int) for x in (a, b)))
    member = np.flatnonzero(label != np.arange(n))
    return member, label[member]


def submasks(free: list[int]) -> list[tuple[int, list[int]]]:
    """Two of four slices of the free bits, as a mask, with the bits still free.

    Values that differ in at most 2 of the bits agree on at least 2 of 4 slices, so on one of the 6 masks.
    """
    q = len(free) // 4
    parts = [free[i * q : (i + 1) * q] for i in range(4)]
    return [(sum(1 << b for b in parts[i] + parts[j]), [b for k in range(4) if k not in (i, j) for b in parts[k]]) for i, j in combinations(range(4), 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


LINK = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (mask, value); a key that goes on in the next batch (BUCKET rows at most) is kept for it."""
    kept = [np.zeros(0, np.int64)] * 4

    def out(rows: list[np.ndarray]) -> pa.RecordBatch:
        key = np.cumsum(np.r_[0, (np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)]) if len(rows[0]) else rows[0]
        i, j = links_in_keys(key, rows[2].view(np.uint64), RADIUS)
        return pa.RecordBatch.from_arrays([pa.array(rows[3][i]), pa.array(rows[3][j])], ["a", "b"])

    for batch in batches:
        rows = [np.concatenate([k, batch.column(i).to_numpy()]) for i, k in enumerate(kept)]
        if not len(rows[0]):
            continue
        cut = int(np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1])).max(initial=-1)) + 1
        kept = [r[cut:] for r in rows]
        yield out([r[:cut] for r in rows])
    yield out(kept)


def links(fingerprints: DataFrame) -> DataFrame:
    """(a, b) spanning links between the ids of distinct fingerprints (id long, fp long) within RADIUS bits.

    Pigeonhole keys of 32 bits; a key of more than BUCKET fingerprints is cut again by its free bits, to
    48 and then to 56 fixed bits, where no key can hold more than 256 distinct values. So no group is
    capped, dropped or gathered whole, and each comparison is bounded.
    """
    spark = fingerprints.sparkSession
    masks = {0: submasks(list(range(64)))}
    rows = fingerprints.select("id", "fp", F.lit(0).cast("long").alias("mask"))
    found, used = None, []
    for level in range(3):
        each = F.create_map(*[x for m, subs in masks.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(m | s)) for s, _ in subs]))])
        keyed = rows.select("id", "fp", F.explode(each[F.col("mask")]).alias("mask")).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp", "id")
        counts, path = materialise(keyed.groupBy("mask", "value").agg(F.count("*").alias("n")).where("n > 1"), "simhash-keys")
        shared, other = materialise(keyed.join(counts, ["mask", "value"]), "simhash-shared")
        used += [path, other]
        # the last level holds 256 values a key at most, and all of its keys are compared
        few = (shared.where(F.col("n") <= BUCKET) if level < 2 else shared).select("mask", "value", "fp", "id").repartition("mask", "value").sortWithinPartitions("mask", "value", "id")
        part = few.mapInArrow(_compare, LINK)
        found = part if found is None else found.unionAll(part)
        rows = shared.where(F.col("n") > BUCKET).select("id", "fp", "mask")
        masks = {m | s: submasks(free) for m, subs in masks.items() for s, free in subs}
    out, _ = materialise(found, "simhash-links")
    for path in used:
        drop_path(spark, path)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links of 2 bits or fewer).

    One row per input row. Null, empty and wordless texts have fingerprint zero and are linked like any
    other. Repeated rows share their component. A row with a null doc_id links others as any row does and
    gets its component's id, which is null if no row of the component has an id. Long texts are read
    whole; an empty table gives no rows; other columns are ignored. A fingerprint of very many rows is a
    hot key of the last join only, whose plain exchanges let Spark split it.
    """
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType())])
    each = lambda batch: {"doc_id": batch.column(0), "fp": np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)}
    prints, _ = materialise(map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), each, schema), "simhash-docs")
    distinct, _ = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("id")), "simhash-distinct")
    components = connected_components(links(distinct.select(F.col("fp").alias("id"), "fp")))
    named = distinct.join(components.select(F.col("node").alias("fp"), "component"), "fp", "left").select("fp", "id", F.coalesce("component", "fp").alias("component"))
    of_print = named.join(named.groupBy("component").agg(F.min("id").alias("component_id")), "component").select("fp", "component_id")
    return prints.join(of_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its near-duplicate component; rows without an id stay."""
    keep = near_duplicates(docs).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(keep, "doc_id", "left_semi").select(docs.columns).unionByName(docs.where("doc_id is null"))

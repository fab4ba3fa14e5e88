"""Near copies by SimHash: wide fingerprints of word shingles, bit-sliced Hamming comparison within keys, and an exact comparison of the texts."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress
from itertools import combinations, repeat
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadloom.llm.common import drop_path, fresh, map_arrow, materialise
from quadloom.llm.components import connected_components
from quadloom.llm.simhash import ALL, bit_planes

#: Words of a shingle, and the similarity of near copies as a fraction.
SHINGLE, SEED, NUMERATOR, DENOMINATOR = 5, 42, 4, 5
#: Words of 64 bits of a fingerprint. At similarity 0.8 a bit differs with a chance of acos(8/9) / pi = 0.1515.
WORDS, AGREE = 4, 0.8485
#: Differing bits up to which a pair is compared, of all 256 (38.8 in the mean at 0.8, deviation 5.7) and of the first 128 (19.4, 4.1).
FAR, HALF_FAR = 68, 44
#: Chance with which a pair at similarity 0.8 shares no key; the number of keys follows from it.
LOST = 0.00003
#: Up to ALONE sets all meet each other; beyond, keys have 6 bits, and more where a key would hold over BUCKET sets in the mean.
ALONE, BUCKET = 4096, 4096
#: Longs of the parity bits: each bit tells whether an odd number of a set's shingles fall on it.
PARITY = 8
#: Keys of a round in which a set meets the nearest set of another component; rounds go on while one links over 1/RARE of the sets.
STARS, RARE = 8, 20
#: 64-bit words of pairs that one step of the comparison takes.
STEP = 8192

_random = np.random.default_rng(SEED)
FLIP, FACTOR = (_random.integers(0, 1 << 64, WORDS, np.uint64) for _ in range(2))
FACTOR |= np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a shorter text is one shingle, one without words has none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - SHINGLE + 1)
    runs = zip(*(words[i:] for i in range(SHINGLE)), strict=False) if len(words) >= SHINGLE else [words]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, runs), repeat(SEED)), np.uint64, n))


def near(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of shingles have a similarity of NUMERATOR / DENOMINATOR or more."""
    if min(len(a), len(b)) * DENOMINATOR < max(len(a), len(b)) * NUMERATOR:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * DENOMINATOR >= (len(a) + len(b) - both) * NUMERATOR


def fingerprint(own: np.ndarray) -> np.ndarray:
    """The SimHash of a set of shingles: bits that over half of their hashes have, in WORDS independent hashes."""
    counts = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(own), 4096):
        mixed = (own[at : at + 4096, None] ^ FLIP) * FACTOR
        mixed = (mixed ^ (mixed >> np.uint64(32))) * FACTOR
        mixed ^= mixed >> np.uint64(29)
        counts += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint16)
    return np.packbits(counts * 2 > len(own), bitorder="little").view(np.uint64)


def parity(own: np.ndarray) -> np.ndarray:
    odd = np.bincount((own >> np.uint64(32)).astype(np.int64) % (64 * PARITY), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.uint64)


def _without_one(own: np.ndarray) -> list[int]:
    """Digests that a set of five shares with each of four at similarity 0.8, the one pair so small that bits tell it badly."""
    some = combinations(own, 4) if len(own) == 5 else [own] if len(own) == 4 else []
    return [xxhash.xxh64_intdigest(np.array(x).tobytes(), 3) - (1 << 63) for x in some]


def _prints(batch: pa.RecordBatch) -> dict:
    digests, sizes, bits, fours = [], [], [], []
    for text in batch.column(2).to_pylist():
        own = shingles(text)
        data = own.tobytes()
        digests.append((xxhash.xxh64_intdigest(data, 1), xxhash.xxh64_intdigest(data, 2)))
        sizes.append(len(own))
        bits.append(fingerprint(own).tobytes() + parity(own).tobytes())
        fours.append(_without_one(own))
    digest = np.array(digests, np.uint64).reshape(-1, 2).view(np.int64)
    return {"row": batch.column(0), "doc_id": batch.column(1), "d1": digest[:, 0], "d2": digest[:, 1], "size": np.array(sizes, np.int64), "bits": bits, "fours": fours}


PRINTS = T.StructType([*[T.StructField(n, T.LongType()) for n in ("row", "doc_id", "d1", "d2", "size")], T.StructField("bits", T.BinaryType()), T.StructField("fours", T.ArrayType(T.LongType()))])
KEYS = T.StructField("keys", T.ArrayType(T.LongType()))
MET = T.StructType([T.StructField("id", T.LongType())])
LINK = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
NEAREST = T.StructType([*LINK.fields, T.StructField("far", T.LongType())])


def tables(n: int) -> np.ndarray:
    """Masks (keys, WORDS) of the bits that the keys of n sets are made of.

    A pair at similarity 0.8 agrees on k bits with a chance of AGREE ** k; there are as many keys as bring the
    chance of none down to LOST, each of bits of its own as far as they go.
    """
    if n <= ALONE:
        return np.zeros((1, WORDS), np.uint64)
    k = max(6, ceil(log2(n / BUCKET)))
    random = np.random.default_rng(SEED)
    each = 64 * WORDS // k
    count = ceil(log(LOST) / log(1 - AGREE**k))
    chosen = np.concatenate([random.permutation(64 * WORDS)[: each * k].reshape(each, k) for _ in range(-(-count // each))])[:count]
    masks = np.zeros((count, 64 * WORDS), bool)
    np.put_along_axis(masks, chosen, True, 1)
    return np.packbits(masks, axis=1, bitorder="little").view(np.uint64)


def _bits(column: pa.Array) -> np.ndarray:
    """Longs of the bits of one row or more, with or without parity."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def _numbered(masks: np.ndarray, which: list[int]) -> Callable:
    """For map_arrow: each set (its bits last) with its keys, of the tables named."""

    def each(batch: pa.RecordBatch) -> dict:
        own = _bits(batch.column(batch.num_columns - 1))[:, :WORDS]
        keys = [[xxhash.xxh64_intdigest(x.tobytes(), t) - (1 << 63) for x in own & masks[t]] for t in which]
        return dict(zip(batch.schema.names, batch.columns, strict=True)) | {"keys": list(map(list, zip(*keys, strict=True)))}

    return each


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and carry of three planes."""
    x = a ^ b
    return x ^ c, (a & b) | (x & c)


def _over(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Bits set where the number in the counter planes (1, 2, 4 ... and one for all beyond) is over the radius."""
    over, same = counters[-1].copy(), np.full_like(counters[-1], ALL)
    for level in reversed(range(len(counters) - 1)):
        if radius >> level & 1:
            same &= counters[level]
        else:
            over |= same & counters[level]
            same &= ~counters[level]
    return over


def _count(counters: list[np.ndarray], planes: Iterator[np.ndarray], n: int) -> None:
    """Adds n bit planes, eight at a time, to the numbers in the counter planes."""
    for _ in range(0, n, 8):
        ones, twos, fours = counters[:3]
        two = []
        for _ in range(4):
            ones, carry = _add(ones, next(planes), next(planes))
            two.append(carry)
        twos, four = _add(twos, two[0], two[1])
        twos, other = _add(twos, two[2], two[3])
        fours, carry = _add(fours, four, other)
        counters[:3] = ones, twos, fours
        for level in range(3, 7):
            counters[level], carry = counters[level] ^ carry, counters[level] & carry
        counters[7] |= carry


def close(rows: np.ndarray, planes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the fingerprints within FAR bits, HALF_FAR in the first half; planes: bit planes of the columns.

    Distances of 64 columns at once are counted in vertical counters by carry-save adders, eight planes at a
    time; half way the blocks of 64 are abandoned that hold nothing within the radius.
    """
    flips = np.where(np.unpackbits(np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1), axis=1, bitorder="little").astype(bool), np.uint64(ALL), np.uint64(0))
    counters = [np.zeros((len(rows), planes.shape[1]), np.uint64) for _ in range(8)]  # 1, 2, 4, 8, 16, 32, 64, and 128 or more
    half = 32 * WORDS
    _count(counters, (planes[b] ^ flips[:, b, None] for b in range(half)), half)
    far = _over(counters, HALF_FAR)
    row, word = np.nonzero(far != np.uint64(ALL))
    if not len(row):
        return row, word
    far, counters = far[row, word], [c[row, word] for c in counters]
    _count(counters, (planes[b, word] ^ flips[row, b] for b in range(half, 2 * half)), half)
    found = ~(far | _over(counters, FAR))
    which, bit = np.nonzero(np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return row[which], word[which] * 64 + bit


def _planes(prints: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints (n, WORDS), the first word's bits first."""
    return np.concatenate([bit_planes(prints[:, i]) for i in range(WORDS)])


def possible(bits: np.ndarray, size: np.ndarray, other_bits: np.ndarray, other_size: np.ndarray) -> np.ndarray:
    """Whether two sets can be near copies by their sizes and parity bits; this never loses a pair.

    Shingles of one set alone are |x| + |y| - 2 |x & y|, which is at most (|x| + |y|) / 9 at similarity 0.8;
    so many parity bits differ at most, and so much the sizes.
    """
    differing = np.bitwise_count(bits[:, WORDS:] ^ other_bits[:, WORDS:]).sum(1, dtype=np.int64)
    apart, whole = DENOMINATOR - NUMERATOR, DENOMINATOR + NUMERATOR
    return np.maximum(differing, np.abs(size - other_size)) * whole <= (size + other_size) * apart


def pairs_of_key(label: np.ndarray, size: np.ndarray, bits: np.ndarray, earlier: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of members of a key (sorted by label) that are close, possible and of two labels, and share none of the earlier keys."""
    n, planes = len(label), _planes(bits[:, :WORDS])
    ends = np.searchsorted(label, label, "right")
    at = 0
    while at < n:
        first = ends[at] if at + 1 < n and ends[at] > at + 1 else at + 1  # columns of the row's own label need no look
        to = min(n, at + max(1, STEP // max(1, planes.shape[1] - first // 64)))
        if first > at + 1:
            to = min(to, ends[at])
        if first >= n:
            break
        i, j = close(bits[at:to, :WORDS], planes[:, first // 64 :])
        i, j = i + at, j + first // 64 * 64
        good = (j > i) & (j < n)
        i, j = i[good], j[good]
        good = label[i] != label[j]
        i, j = i[good], j[good]
        good = possible(bits[i], size[i], bits[j], size[j])
        i, j = i[good], j[good]
        good = np.ones(len(i), bool)
        for mask in earlier:
            good &= ((bits[i, :WORDS] ^ bits[j, :WORDS]) & mask).any(1)
        yield i[good], j[good]
        at = to


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Whole keys of rows sorted by key, which is the first column; the last one is the bits."""
    kept: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        *numbers, bits = batch.columns
        columns = [c.to_numpy() for c in numbers] + [_bits(bits)]
        cuts = [0, *(np.flatnonzero(np.diff(columns[0])) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:], strict=False):
            part = [c[start:end] for c in columns]
            if kept and kept[-1][0][0] != part[0][0]:
                yield tuple(np.concatenate(c) for c in zip(*kept, strict=True))
                kept = []
            kept.append(part)
    if kept:
        yield tuple(np.concatenate(c) for c in zip(*kept, strict=True))


NO_KEYS = np.zeros((0, WORDS), np.uint64)


def _all(masks: np.ndarray) -> Callable:
    """Pairs (a, b) of each key, in the first of the keys that they share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table, ids, label, size, bits in _groups(batches):
            if label[0] != label[-1]:
                for i, j in pairs_of_key(label, size, bits, masks[: table[0]]):
                    if len(i):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[i], ids[j])), pa.array(np.maximum(ids[i], ids[j]))], ["a", "b"])
        _give_back()

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of the members (key, id, size, fingerprint) that are close to another of their key, and of a possible size."""
    for _, ids, size, prints in _groups(batches):
        met = np.zeros(len(ids), bool)
        for i, j in pairs_of_key(np.arange(len(ids)), size, prints, NO_KEYS):
            met[i] = met[j] = True
        if met.any():
            yield pa.RecordBatch.from_arrays([pa.array(ids[met])], ["id"])
    _give_back()


def nearest_of_key(label: np.ndarray, size: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(member, the nearest that pairs_of_key gives it, their differing bits); a number for each member is held, no pairs."""
    other, least = np.zeros(len(label), np.int64), np.full(len(label), 64 * WORDS + 1)
    for i, j in pairs_of_key(label, size, bits, NO_KEYS):
        far = np.bitwise_count(bits[i, :WORDS] ^ bits[j, :WORDS]).sum(1, dtype=np.int64)
        for x, y in ((i, j), (j, i)):
            order = np.lexsort((y, far, x))
            first = order[np.flatnonzero(np.diff(x[order], prepend=-1))]
            first = first[far[first] < least[x[first]]]
            least[x[first]], other[x[first]] = far[first], y[first]
    found = np.flatnonzero(least <= 64 * WORDS)
    return found, other[found], least[found]


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each member of a key with the nearest of another label, where one is close and possible."""
    for _, _, ids, label, size, bits in _groups(batches):
        if label[0] != label[-1]:
            i, j, far = nearest_of_key(label, size, bits)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j]), pa.array(far)], ["a", "b", "far"])
    _give_back()


def _give_back() -> None:
    """Returns what a worker has freed to the system, as workers live on beside the heap of their executor."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, text of a, text of b) that are near copies; the shingles of the last b are kept."""
    last, held = None, np.zeros(0, np.uint64)
    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        good = []
        for i, (x, y) in enumerate(zip(a, b, strict=True)):
            if y != last:
                last, held = y, shingles(batch.column(3)[i].as_py())
            if near(shingles(batch.column(2)[i].as_py()), held):
                good.append((x, y))
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in good], pa.int64()) for k in (0, 1)], ["a", "b"])
    _give_back()


#: Row numbers in one bitmap.
BITMAP = 32768


def among(rows: DataFrame, name: str, ids: DataFrame) -> tuple[DataFrame, str]:
    """The rows whose number is one of ids (id, distinct or not), and the path of a table to drop.

    The ids go out as bitmaps, 4 KB for 32,768 rows or a partition, so that no text is moved for being looked at.
    """
    bits = ids.groupBy(F.expr(f"id div {BITMAP}").alias("near_at")).agg(F.bitmap_construct_agg(F.pmod("id", F.lit(BITMAP))).alias("near_bits"))
    bits, path = materialise(bits, "near-bitmap")
    at = F.pmod(F.col(name), F.lit(BITMAP))
    byte = F.conv(F.hex(F.substring("near_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("near_at", F.expr(f"`{name}` div {BITMAP}")).join(F.broadcast(bits), "near_at")
    return found.where(F.getbit(byte, F.pmod(F.col(name), F.lit(8)).cast("int")) == 1).drop("near_at", "near_bits"), path


def _keyed(sets: DataFrame, masks: np.ndarray, which: list[int]) -> DataFrame:
    """(key, table, and the columns of sets, their bits last), a row for each set and table named, a key in one task."""
    schema = T.StructType([*sets.schema.fields, KEYS])
    keyed = map_arrow(sets, _numbered(masks, which), schema).select("*", F.posexplode("keys").alias("table", "key"))
    return keyed.select("key", F.col("table").cast("long"), *sets.columns).repartition("key")


def not_alone(sets: DataFrame, masks: np.ndarray) -> tuple[DataFrame, list[str]]:
    """The sets that are close to another one in some key, and the paths of tables to drop.

    Only they can be near copies. Fingerprints go to the keys alone, without parity bits, a third as long; what
    is left is few enough to go there with them, again and again.
    """
    prints = sets.select("id", "size", F.substring("bits", 1, 8 * WORDS).alias("bits"))
    met = _keyed(prints, masks, list(range(len(masks)))).drop("table").sortWithinPartitions("key", "id").mapInArrow(_met, MET)
    some, path = among(sets, "id", met)
    some, some_path = materialise(some, "near-met")
    return some, [path, some_path]


def candidates(sets: DataFrame, masks: np.ndarray, nth: int | None) -> DataFrame:
    """Pairs (a, b) of labelled sets (id, label, size, bits) to be compared; nth: the round, None for all pairs that are left."""
    which = list(range(len(masks))) if nth is None else [(nth * STARS + x) % len(masks) for x in range(min(STARS, len(masks)))]
    keyed = _keyed(sets.select("id", "label", "size", "bits"), masks, which).sortWithinPartitions("key", "label", "id")
    if nth is None:
        return keyed.mapInArrow(_all(masks), LINK)
    return keyed.mapInArrow(_nearest, NEAREST).groupBy("a").agg(F.min(F.struct("far", "b")).alias("c")).select(F.least("a", "c.b").alias("a"), F.greatest("a", "c.b").alias("b")).distinct()


def links(sets: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, component) of the ids of distinct sets (id, size, bits, fours) that have near copies; texts: id, text.

    Sets that no key brings close to another are left out first. Then, in rounds, each set meets the nearest set
    of another component in some of its keys, so that a group is one component before its members would all
    meet: a round has no more pairs than sets. At last all sets of a key meet whose components differ. Pairs are
    compared by their fingerprints first, then by sizes and parity bits, and every link is one of exact
    similarity; texts that no pair names are not moved.
    """
    spark = sets.sparkSession
    masks = tables(sets.count())
    four = sets.where("size in (4, 5)").select("id", "size", F.explode("fours").alias("four"))
    five = four.where("size = 5").select(F.col("id").alias("a"), "four").hint("merge")
    found, path = materialise(five.join(four.where("size = 4").select(F.col("id").alias("b"), "four"), "four").select("a", "b"), "near-links")
    gone, components = [path], None
    some, nth = sets.where("size >= 4").select("id", "size", "bits"), None
    if len(masks) > 1:
        some, paths = not_alone(some, masks)
        gone, n, nth = gone + paths, some.count(), 0
    while True:
        labelled = some.withColumn("label", F.col("id"))
        if components is not None:
            labelled = labelled.drop("label").join(components.select(F.col("node").alias("id"), F.col("component").alias("label")), "id", "left").withColumn("label", F.coalesce("label", "id"))
        pairs, path = materialise(candidates(labelled, masks, nth), "near-pairs")
        gone.append(path)
        linked = 0
        if not pairs.isEmpty():
            named, path = among(texts, "id", pairs.select(F.explode(F.array("a", "b")).alias("id")))
            gone.append(path)
            of = lambda n, text, t=named: t.select(F.col("id").alias(n), F.col("text").alias(text)).hint("merge")
            both = pairs.join(of("a", "ta"), "a").join(of("b", "tb"), "b").select("a", "b", "ta", "tb")
            more, path = materialise(both.mapInArrow(_verified, LINK), "near-links")
            gone.append(path)
            found, linked = found.unionAll(more), more.count()
        if linked or nth is None:
            components, path = materialise(connected_components(found), "near-components")
        if nth is None:
            break
        if linked:
            gone.append(path)
        nth = nth + 1 if linked * RARE > n else None
    for path in gone:
        drop_path(spark, path)
    return components


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of docs for each component of near copies: that of the smallest doc_id, one without an id only if none has one.

    Near copies share 4/5 or more of their distinct 5-word shingles (lower case, split at white space);
    texts of fewer words are copies if their words are equal, and so are all texts without words, null
    ones among them. Of rows that repeat a doc_id in a component one stays. Texts are read whole; an empty
    table gives no rows; all columns are kept, whatever their names.
    """
    spark = docs.sparkSession
    name = fresh(docs, "near_row")
    rows, _ = materialise(docs.withColumn(name, F.monotonically_increasing_id()), "near-rows")
    prints, prints_path = materialise(map_arrow(rows.select(name, F.col("doc_id").cast("long"), "text"), _prints, PRINTS), "near-prints")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("best")
    one = prints.groupBy("d1", "d2").agg(best, F.first("size").alias("size"), F.first("bits").alias("bits"), F.first("fours").alias("fours"))
    sets, sets_path = materialise(one.select(F.col("best.row").alias("id"), "best", "size", "bits", "fours"), "near-sets")
    components = links(sets, rows.select(F.col(name).alias("id"), "text"))
    keep = sets.select("id", "best").join(components.withColumnRenamed("node", "id"), "id", "left").groupBy(F.coalesce("component", "id").alias("c")).agg(F.min("best").alias("best")).select(F.col("best.row").alias("id"))
    kept, _ = among(rows, name, keep)
    for path in (prints_path, sets_path):
        drop_path(spark, path)
    return kept.select(docs.columns)

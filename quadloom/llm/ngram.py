"""LM scoring: a sharded trigram trie with Elias-Fano pointers and quantised discounted probabilities."""

from __future__ import annotations

import json
import mmap
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadloom.llm.common import mounted, new_path, remainder

SEED = 42
#: The end of a text, and the context of its first word: no word contains white space.
END = xxhash.xxh64_intdigest(b"\n", SEED)
#: The absolute discount.
DISCOUNT = 0.75
#: Log10 probabilities in 255 equal steps down to FLOOR.
FLOOR = -12.75
#: Words that are counted and looked up together.
CHUNK = 400_000
#: Bytes of training text to a shard of words, and the occurrences of one word beyond which its contexts are split.
SHARD_BYTES, HOT = 16 << 20, 1_000_000
#: What no word is: the third word of a bigram that ends a text.
NONE = np.uint32((1 << 32) - 1)

POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.int64)
SELECT = np.array([[([b for b in range(8) if i >> b & 1] + [0] * 8)[r] for r in range(8)] for i in range(256)], np.int64)


@dataclass
class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary, and the ones before each word of the unary part."""

    low: np.ndarray
    high: np.ndarray
    before: np.ndarray
    width: int

    @staticmethod
    def encode(values: np.ndarray) -> EliasFano:
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = max(0, (top // max(1, n)).bit_length() - 1)
        values = values.astype(np.uint64)
        bits = np.zeros(n * width, np.uint8)
        for b in range(width):
            bits[b::width] = (values >> np.uint64(b)) & np.uint64(1)
        low = np.packbits(np.r_[bits, np.zeros(-len(bits) % 64 + 64, np.uint8)], bitorder="little").view(np.uint64)
        at = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        unary = np.zeros(-(-(int(at[-1]) + 1 if n else 1) // 64) * 64, np.uint8)
        unary[at] = 1
        high = np.packbits(unary, bitorder="little").view(np.uint64)
        ones = POPCOUNT[high.view(np.uint8).reshape(-1, 8)].sum(1)
        return EliasFano(low, high, np.r_[0, np.cumsum(ones)[:-1]].astype(np.int64), width)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """Values at the positions i."""
        word = np.searchsorted(self.before, i, side="right") - 1
        left = i - self.before[word]
        octets = np.ascontiguousarray(self.high[word]).view(np.uint8).reshape(-1, 8)
        sums = np.cumsum(POPCOUNT[octets], axis=1)
        octet = (sums <= left[:, None]).sum(1)
        rows = np.arange(len(i))
        left = left - np.where(octet > 0, sums[rows, octet - 1], 0)
        high = word * 64 + octet * 8 + SELECT[octets[rows, octet], left] - i
        if not self.width:
            return high
        at = i * self.width
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        low = self.low[word] >> shift
        spill = (self.low[word + 1] << np.uint64(1)) << (np.uint64(63) - shift)
        return (high << self.width) | ((low | spill) & np.uint64((1 << self.width) - 1)).astype(np.int64)


def word_hashes(text: str | None) -> np.ndarray:
    """XXH64 of each word, A-Z lowered, and END."""
    words = (text or "").encode().lower().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, [*words, b"\n"], repeat(SEED)), np.uint64, len(words) + 1)


def _chunks(texts: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Hashes of texts in runs of some CHUNK words, with the index of the first text."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        held.append(word_hashes(text.as_py()))
        size += len(held[-1])
        if size >= CHUNK:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def _packed(arrays: list[np.ndarray]) -> bytes:
    """Integer arrays of one length as bytes: differences, byte by byte, compressed."""
    parts = []
    for a in arrays:
        step = np.diff(a, prepend=a.dtype.type(0))
        parts.append(np.ascontiguousarray(step.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpacked(data: bytes, types: list) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    widths = [np.dtype(t).itemsize for t in types]
    n, at, out = len(raw) // sum(widths), 0, []
    for t, w in zip(types, widths, strict=True):
        planes = np.frombuffer(raw, np.uint8, n * w, at).reshape(w, n)
        out.append(np.cumsum(np.ascontiguousarray(planes.T).view(t).reshape(-1), dtype=t))
        at += n * w
    return out


class Level:
    """Arrays of one shard in one memory-mapped file: a line that tells where they lie, then the arrays."""

    @staticmethod
    def write(path: str, arrays: dict[str, np.ndarray]) -> None:
        """In one step, so that a task that runs again, on this machine or another, puts the same file in place of its own."""
        at, told = 0, {}
        for name, a in arrays.items():
            told[name] = (at, len(a), a.dtype.str)
            at += -(-a.nbytes // 8) * 8
        line = json.dumps(told).encode()
        line += b" " * (-(len(line) + 1) % 64) + b"\n"
        part = f"{path}.{uuid.uuid4().hex}.part"
        with open(part, "wb") as out:
            out.write(line)
            for a in arrays.values():
                out.write(a.tobytes() + bytes(-a.nbytes % 8))
        os.replace(part, path)

    def __init__(self, path: str):
        with open(path, "rb") as f:
            line = f.readline()
            data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        for name, (at, n, kind) in json.loads(line).items():
            setattr(self, name, np.frombuffer(data, kind, n, len(line) + at))


def _pointers(name: str, counts: np.ndarray) -> dict[str, np.ndarray]:
    code = EliasFano.encode(np.r_[0, np.cumsum(counts)])
    return {f"{name}_low": code.low, f"{name}_high": code.high, f"{name}_before": code.before, f"{name}_width": np.array([code.width])}


def _restored_pointers(level: Level, name: str) -> EliasFano:
    return EliasFano(*(getattr(level, f"{name}_{x}") for x in ("low", "high", "before")), int(getattr(level, f"{name}_width")[0]))


def successor(words: np.ndarray, lo: np.ndarray, end: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted word among words[lo:end], which are sorted, or -1; all searches go abreast."""
    lo, hi = lo.copy(), end.copy()
    open_ = np.flatnonzero(lo < hi)
    while open_.size:
        mid = (lo[open_] + hi[open_]) >> 1
        less = words[mid] < wanted[open_]
        lo[open_] = np.where(less, mid + 1, lo[open_])
        hi[open_] = np.where(less, hi[open_], mid)
        open_ = open_[lo[open_] < hi[open_]]
    inside = np.flatnonzero(lo < end)
    out = np.full(len(lo), -1)
    hit = inside[words[lo[inside]] == wanted[inside]]
    out[hit] = lo[hit]
    return out


class Contexts:
    """The second and third level below one shard's first words."""

    def __init__(self, path: str):
        level = Level(path)
        self.second, self.share2, self.rest2, self.rest3 = level.second, level.share2, level.rest2, level.rest3
        self.third, self.share3 = level.third, level.share3
        self.down, self.further = _restored_pointers(level, "down"), _restored_pointers(level, "further")

    def seconds(self, first: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Places of the bigrams (place of the first word in the shard, id), or -1."""
        own, back = np.unique(first, return_inverse=True)
        ends = self.down[np.r_[own, own + 1]].reshape(2, -1)
        return successor(self.second, ends[0][back], ends[1][back], word)

    def thirds(self, bigram: np.ndarray, word: np.ndarray) -> np.ndarray:
        own, back = np.unique(bigram, return_inverse=True)
        ends = self.further[np.r_[own, own + 1]].reshape(2, -1)
        return successor(self.third, ends[0][back], ends[1][back], word)


def quantised(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint((log10 / FLOOR) * 255), 0, 255).astype(np.uint8)


RESTORED = 10 ** (np.arange(256) / 255 * FLOOR)


def restored(code: np.ndarray) -> np.ndarray:
    """Probabilities of quantised logarithms."""
    return RESTORED[code]


BLOB = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("data", T.BinaryType())])
SIZE = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("size", T.LongType()), T.StructField("total", T.LongType()), T.StructField("hot", T.ArrayType(T.LongType())), T.StructField("often", T.ArrayType(T.LongType()))])


@dataclass(frozen=True)
class Model:
    """Where the levels lie. base: id of the first word of each shard and their number; hot: the words whose contexts are
    split, in order, with their first own shard and the number of shards; rest: the back-off weights of those words."""

    folder: str
    tokens: int
    bits: int
    base: np.ndarray
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    start: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    parts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    rest: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @property
    def words(self) -> int:
        return int(self.base[-1])

    def shard(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Shard of the bigrams of known words: that of the first word, or one of its own if it is hot."""
        out = np.searchsorted(self.base, first, side="right") - 1
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, first), len(self.hot) - 1)
            is_hot = self.hot[at] == first
            mixed = (second.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            out = np.where(is_hot, self.start[at] + mixed % self.parts[at], out)
        return out

    def place(self, shard: int, first: np.ndarray) -> np.ndarray:
        """Place of first words in their shard; a hot word is alone in its own."""
        return first - self.base[shard] if shard < len(self.base) - 1 else np.zeros(len(first), np.int64)


class Words:
    """The first level: sorted hashes and counts, mapped as they are asked for."""

    def __init__(self, model: Model):
        self.model, self.levels = model, {}

    def find(self, sorted_hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, count) of hashes in ascending order."""
        ids, counts = np.full(len(sorted_hashes), -1, np.int64), np.zeros(len(sorted_hashes), np.int64)
        cut = np.searchsorted(_shards_of(sorted_hashes, self.model.bits), np.arange((1 << self.model.bits) + 1))
        for s in np.flatnonzero((np.diff(cut) > 0) & (np.diff(self.model.base) > 0)).tolist():
            if s not in self.levels:
                self.levels[s] = Level(f"{self.model.folder}/words-{s}")
            part, own = sorted_hashes[cut[s] : cut[s + 1]], self.levels[s]
            at = np.minimum(np.searchsorted(own.hash, part), len(own.hash) - 1)
            known = own.hash[at] == part
            ids[cut[s] : cut[s + 1]] = np.where(known, self.model.base[s] + at, -1)
            counts[cut[s] : cut[s + 1]] = np.where(known, own.count[at], 0)
        return ids, counts


def _shards_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The first bits of a hash, so that shards and ids follow the order of the hashes."""
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def _blobs(shard: np.ndarray, arrays: list[np.ndarray]) -> pa.RecordBatch:
    """One row for each shard of rows in its order."""
    cut = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])[: len(shard)].tolist()
    ends = [*cut[1:], len(shard)]
    data = [_packed([a[x:y] for a in arrays]) for x, y in zip(cut, ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(shard[cut].astype(np.int32)), pa.array(data, pa.binary())], ["shard", "data"])


def _by_shard(blobs: DataFrame, shards: int, types: list, write: Callable[[int, list[np.ndarray]], tuple]) -> list:
    """Calls write(shard, arrays) for each shard, one at a time in a task; its (size, total, hot, often) as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, bytes]]:
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), (x.as_py() for x in batch.column(1)), strict=True)
            yield -1, b""

        now, held = -1, []
        for shard, data in rows():
            if shard != now and held:
                got = write(now, [np.concatenate(x) for x in zip(*held, strict=True)])
                held = []
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), *[pa.array([x], f) for x, f in zip(got, (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)]], ["shard", "size", "total", "hot", "often"])
            now = shard
            if shard >= 0:
                held.append(_unpacked(data, types))

    return blobs.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(run, SIZE).collect()


def _summed(counts: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(counts, first) if len(first) else np.zeros(0, np.int64)


def _changes(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    n = len(sorted_keys[0])
    differs = np.zeros(max(0, n - 1), bool)
    for k in sorted_keys:
        differs |= k[1:] != k[:-1]
    return np.flatnonzero(np.r_[True, differs])[:n]


def fit(texts: DataFrame) -> Model:
    """Counts every word, bigram and trigram of ``texts`` (one column, text) and writes the levels to the shared folder.

    Words are their 64-bit hashes, and a shard is the first bits of a hash, as many as keep a shard to
    SHARD_BYTES of text; ids are the order of the hashes. A task counts its own words, and its trigrams,
    in chunks and sends one compressed row for a shard. Trigrams lie with their first word, but a word of
    more than HOT occurrences has shards of its own, dealt out by the second word, so no task gathers
    more than some shard's worth. Nothing is left out, whatever its count.

    Interpolated absolute discounting: p(w|uv) = (n(uvw) - D) / n(uv) + D d(uv) / n(uv) p(w|v), likewise
    p(w|v) from p(w) = (c + 1) / (N + V + 1), where d is the number of different successors; the first
    word of a text has the end as its only context. The levels hold the two terms, in 8 bits each.
    """
    folder = mounted(new_path(texts.sparkSession, "ngram"))
    os.makedirs(folder)
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = max(0, (-(-size // SHARD_BYTES) - 1).bit_length())

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, held in _chunks(batch.column(0)):
                keys, n = np.unique(np.concatenate(held), return_counts=True)
                yield _blobs(_shards_of(keys, bits), [keys, n.astype(np.uint32)])

    def write_words(shard: int, arrays: list[np.ndarray]) -> tuple:
        order = np.argsort(arrays[0], kind="stable")
        keys, n = arrays[0][order], arrays[1][order].astype(np.int64)
        first = _changes(keys)
        keys, n = keys[first], _summed(n, first)
        Level.write(f"{folder}/words-{shard}", {"hash": keys, "count": n})
        hot = np.flatnonzero(n > HOT)
        return len(keys), int(n.sum()), hot.tolist(), n[hot].tolist()

    told = {r.shard: r for r in _by_shard(texts.mapInArrow(words, BLOB), 1 << bits, [np.uint64, np.uint32], write_words)}
    base = np.r_[0, np.cumsum([told[s].size if s in told else 0 for s in range(1 << bits)])].astype(np.int64)
    if base[-1] >= int(NONE):
        raise ValueError("over 2^32 - 1 different words; ids are 32 bits wide")
    hot = [(int(base[s]) + at, n) for s in sorted(told) for at, n in zip(told[s].hot, told[s].often, strict=True)]
    parts = np.array([-(-2 * n // HOT) for _, n in hot], np.int64)
    start = (1 << bits) + np.r_[0, np.cumsum(parts)][: len(hot)].astype(np.int64)
    model = Model(folder, sum(r.total for r in told.values()), bits, base, np.array([i for i, _ in hot], np.int64), start, parts)

    def trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = Words(model)
        for batch in batches:
            for _, held in _chunks(batch.column(0)):
                seen, at = np.unique(np.concatenate(held), return_inverse=True)
                ids = level.find(seen)[0]
                before, later = _contexts(held, at, int(np.searchsorted(seen, np.uint64(END))))
                # (first, second, third) for every word but a text's first, and (last, end, none) for every text
                ends = np.cumsum([len(h) for h in held]) - 1
                first = ids[np.r_[before[later - 1], before[ends]]].astype(np.uint32)
                middle = ids[np.r_[at[later - 1], at[ends]]].astype(np.uint32)
                third = np.r_[ids[at[later]].astype(np.uint32), np.full(len(ends), NONE)]
                shard = model.shard(first.astype(np.int64), middle.astype(np.int64))
                pair = first.astype(np.uint64) << np.uint64(32) | middle
                order = np.lexsort((third, pair, shard))
                pair, third, shard = pair[order], third[order], shard[order]
                begin = _changes(pair, third)
                n = np.diff(np.r_[begin, len(pair)]).astype(np.uint32)
                yield _blobs(shard[begin], [(pair[begin] >> np.uint64(32)).astype(np.uint32), pair[begin].astype(np.uint32), third[begin], n])

    def write_contexts(shard: int, arrays: list[np.ndarray]) -> tuple:
        first, second, third, n = arrays
        pair = first.astype(np.uint64) << np.uint64(32) | second
        order = np.lexsort((third, pair))
        pair, third, n = pair[order], third[order], n[order].astype(np.int64)
        begin = _changes(pair, third)
        pair, third, n = pair[begin], third[begin], _summed(n, begin)
        begin = _changes(pair)
        n2, pairs = _summed(n, begin), pair[begin]
        of = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(pair)]))
        real = third != NONE
        different = np.bincount(of[real], minlength=len(begin))
        place = model.place(shard, (pairs >> np.uint64(32)).astype(np.int64))
        contexts = int(base[shard + 1] - base[shard]) if shard < len(base) - 1 else 1
        successors = np.bincount(place, minlength=contexts)
        if shard < len(base) - 1:
            seen = np.maximum(1, np.asarray(Level(f"{folder}/words-{shard}").count))
        else:
            seen = np.array([hot[int(np.searchsorted(start, shard, side="right")) - 1][1]])
        log = lambda x: np.log10(np.maximum(x, 10**FLOOR))
        arrays = {"second": pairs.astype(np.uint32), "third": third[real], "share2": quantised(log((n2 - DISCOUNT) / seen[place])), "rest2": quantised(log(DISCOUNT * successors / seen)), "share3": quantised(log((n[real] - DISCOUNT) / n2[of[real]])), "rest3": quantised(log(DISCOUNT * different / n2))}
        Level.write(f"{folder}/contexts-{shard}", arrays | _pointers("down", successors) | _pointers("further", different))
        return len(pairs), len(third), [len(pairs)], []

    shards = (1 << bits) + int(parts.sum())
    got = {r.shard: r.size for r in _by_shard(texts.mapInArrow(trigrams, BLOB), shards, [np.uint32] * 4, write_contexts)}
    rest = np.array([DISCOUNT * sum(got.get(int(start[i]) + j, 0) for j in range(int(parts[i]))) / n for i, (_, n) in enumerate(hot)])
    return Model(folder, model.tokens, bits, base, model.hot, start, parts, rest)


def _contexts(held: list[np.ndarray], at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """For texts whose words have the numbers ``at``: the number of the word before each (``end`` before a text's first),
    and the places of the words that are not a text's first."""
    starts = np.cumsum([0, *map(len, held)])[:-1]
    before = np.r_[end, at[:-1]]
    before[starts] = end
    later = np.ones(len(at), bool)
    later[starts] = False
    return before, np.flatnonzero(later)


def _groups(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places of its rows); -1 is no shard."""
    if not len(shard):
        return
    order = np.argsort(shard, kind="stable")
    cut = _changes(shard[order]).tolist()
    for x, y in zip(cut, [*cut[1:], len(order)], strict=True):
        if shard[order[x]] >= 0:
            yield int(shard[order[x]]), order[x:y]


class Trie:
    """All levels of a model; those of a shard are mapped when they are first asked for."""

    def __init__(self, model: Model):
        self.model, self.words, self.levels = model, Words(model), {}

    def contexts(self, shard: int) -> Contexts:
        if shard not in self.levels:
            self.levels[shard] = Contexts(f"{self.model.folder}/contexts-{shard}")
        return self.levels[shard]

    def rest(self, first: np.ndarray) -> np.ndarray:
        """Back-off weights of known words."""
        out = np.zeros(len(first))
        base = np.searchsorted(self.model.base, first, side="right") - 1
        if len(self.model.hot):
            at = np.minimum(np.searchsorted(self.model.hot, first), len(self.model.hot) - 1)
            hot = self.model.hot[at] == first
            out[hot] = self.model.rest[at[hot]]
            base = np.where(hot, -1, base)
        for s, mine in _groups(base):
            out[mine] = restored(self.contexts(s).rest2[first[mine] - self.model.base[s]])
        return out

    def probabilities(self, held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(count, base probability, probability) of each word of the texts."""
        model = self.model
        seen, at = np.unique(np.concatenate(held), return_inverse=True)
        ids, counts = self.words.find(seen)
        one = (counts + 1) / (model.tokens + model.words + 1)
        before, later = _contexts(held, at, int(np.searchsorted(seen, np.uint64(END))))
        pairs, of = np.unique(before.astype(np.uint64) << np.uint64(32) | at.astype(np.uint64), return_inverse=True)
        c, w = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64((1 << 32) - 1)).astype(np.int64)
        # the second level: bigrams of known words
        shard = np.full(len(pairs), -1)
        known = np.flatnonzero((ids[c] >= 0) & (ids[w] >= 0))
        shard[known] = model.shard(ids[c[known]], ids[w[known]])
        place, share = np.full(len(pairs), -1), np.zeros(len(pairs))
        rest3 = np.ones(len(pairs))
        for s, mine in _groups(shard):
            # a shard of a hot word has no file if none of its successors fell to it
            if s >= 1 << model.bits and not os.path.exists(f"{model.folder}/contexts-{s}"):
                continue
            level = self.contexts(s)
            got = level.seconds(model.place(s, ids[c[mine]]), ids[w[mine]].astype(np.uint32))
            hit = mine[got >= 0]
            place[hit] = got = got[got >= 0]
            share[hit], rest3[hit] = restored(level.share2[got]), restored(level.rest3[got])
        told = np.flatnonzero(ids >= 0)
        rest2 = np.ones(len(seen))
        context = told[np.isin(told, c)]
        rest2[context] = self.rest(ids[context])
        two = share + rest2[c] * one[w]
        # the third level: words after a known bigram
        out, after = two[of], of[later - 1]
        mine = np.flatnonzero(place[after] >= 0)
        where, after = later[mine], after[mine]
        out[where] *= rest3[after]
        follow = np.flatnonzero(ids[at[where]] >= 0)
        for s, own in _groups(shard[after[follow]]):
            own = follow[own]
            level = self.contexts(s)
            got = level.thirds(place[after[own]], ids[at[where[own]]].astype(np.uint32))
            hit = got >= 0
            out[where[own[hit]]] += restored(level.share3[got[hit]])
        return counts[at], one[at], out


def score(docs: DataFrame, held_out: Column, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per input row.

    Null and empty texts are one token, the end. Long texts are scored whole. Without training texts
    every probability is 1. Repeated rows are scored alike and there are no ties to break; other columns
    are ignored. An empty table: no rows.
    """
    fields = [("doc_id", T.LongType()), ("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())]
    schema = T.StructType([T.StructField(*f) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(model)
        for batch in batches:
            for first, held in _chunks(batch.column(2)):
                counts, base, own = trie.probabilities(held)
                lengths = np.array([len(h) for h in held])
                starts, n = np.r_[0, np.cumsum(lengths)[:-1]], len(held)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), batch.column(1).slice(first, n), pa.array(lengths), pa.array(np.add.reduceat((counts > 0).astype(np.int64), starts)), pa.array(np.full(n, model.tokens)), pa.array(np.add.reduceat(np.log10(base), starts)), pa.array(np.add.reduceat(np.log10(own), starts))],
                    [f[0] for f in fields],
                )

    return docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), "text").mapInArrow(run, schema)


def fit_and_score(docs: DataFrame) -> DataFrame:
    """Learns from texts whose crc32(doc_id) mod 7 is not 2 and scores all."""
    fold = remainder(F.col("doc_id"), 7) == 2
    return score(docs, fold, fit(docs.where(~fold).select("text")))

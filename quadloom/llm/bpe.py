"""Byte-level BPE with a hierarchical-bitmap rank queue."""

from __future__ import annotations

import base64
import hashlib
from array import array
from dataclasses import dataclass, field
from heapq import heappop, heappush

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadloom.llm.common import map_arrow


class RankQueue:
    """The set of ranks with waiting pairs as a three-level bitmap; a bucket per rank holds list positions.

    The next rank is found by find-first-set from the top word down. A bucket is a heap, so positions of
    one rank come out from left to right even if a merge adds one later. ``pop`` leaves the queue empty
    in the end, so one queue serves all pre-tokens.
    """

    __slots__ = ("low", "mid", "top", "buckets")

    def __init__(self, ranks: int):
        self.low, self.mid, self.top = [0] * ((ranks >> 6) + 1), [0] * ((ranks >> 12) + 1), 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        buckets = self.buckets
        if rank in buckets:
            heappush(buckets[rank], position)
        else:
            buckets[rank] = [position]
            self.low[rank >> 6] |= 1 << (rank & 63)
            self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
            self.top |= 1 << (rank >> 12)

    def pop(self) -> tuple[int, int]:
        """The lowest rank and its leftmost position; the queue must not be empty."""
        top, mid, low = self.top, self.mid, self.low
        a = (top & -top).bit_length() - 1
        word = mid[a]
        b = a << 6 | (word & -word).bit_length() - 1
        bits = low[b]
        rank = b << 6 | (bits & -bits).bit_length() - 1
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heappop(bucket)
        del self.buckets[rank]
        low[b] = bits = bits & (bits - 1)
        if not bits:
            mid[a] = word = word & (word - 1)
            if not word:
                self.top = top & (top - 1)
        return rank, bucket[0]


@dataclass
class Tokenizer:
    ranks: dict[bytes, int]
    pattern: str
    #: Pre-tokens remembered, and the longest of them in characters; both bound the cache's memory.
    remembered: int = 1_000_000
    longest: int = 64
    _cache: dict[str, bytes] = field(default_factory=dict)
    _older: dict[str, bytes] = field(default_factory=dict)

    def __post_init__(self):
        self.bytes_of = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self._find, self._queue = regex.compile(self.pattern).findall, RankQueue(len(self.bytes_of))

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the lowest-ranked pair merges first, the leftmost among equals."""
        ranks, n = self.ranks, len(piece)
        if piece in ranks:
            return [ranks[piece]]
        queue, get = self._queue, ranks.get
        push, pop = queue.push, queue.pop
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # the linked list of tokens by start
        after.append(n)
        # rank of the pair that starts at a position; a queue entry of another rank is stale
        due = [get(piece[i : i + 2], -1) for i in range(n - 1)] + [-1, -1]
        for i, r in enumerate(due):
            if r >= 0:
                push(r, i)
        while queue.top:
            rank, i = pop()
            if due[i] != rank:
                continue
            j = after[i]
            k = after[i] = after[j]
            due[j] = -1
            if k < n:
                before[k] = i
                due[i] = r = get(piece[i : after[k]], -1)
                if r >= 0:
                    push(r, i)
            else:
                due[i] = -1
            h = before[i]
            if h >= 0:
                due[h] = r = get(piece[h:k], -1)
                if r >= 0:
                    push(r, h)
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : after[i]]])
            i = after[i]
        return ids

    def _miss(self, piece: str) -> bytes:
        # a text goes on asking the half that was the younger one when it began
        if (got := self._cache.get(piece)) is not None:
            return got
        if (got := self._older.get(piece)) is not None:
            self._remember(piece, got)
            return got
        got = np.array(self.merge(piece.encode()), "<u4").tobytes()
        if len(piece) <= self.longest:
            self._remember(piece, got)
        return got

    def _remember(self, piece: str, got: bytes) -> None:
        """Into the younger half; when it is full the older one goes, so that what is met often stays."""
        if len(self._cache) * 2 >= self.remembered:
            self._older, self._cache = self._cache, {}
        self._cache[piece] = got

    def encode_packed(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        get, miss = self._cache.get, self._miss
        return b"".join([get(p) or miss(p) for p in self._find(text or "")])

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


_ready: dict[tuple, Tokenizer] = {}


def _tokenizer(told) -> Tokenizer:
    """One per worker: the broadcast ranks with their cache."""
    if told.id not in _ready:
        _ready.clear()
        _ready[told.id] = Tokenizer(*told.value)
    return _ready[told.id]


class _Told:
    def __init__(self, shared, ident: str):
        self.shared, self.id = shared, ident

    @property
    def value(self):
        return self.shared.value


def encode(docs: DataFrame, path: str, pattern: str, with_ids: bool = False, remembered: int = Tokenizer.remembered) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, if asked for); one row per input row.

    The rank file is read once by the driver and broadcast; a vocabulary's size does not depend on the
    data. Null text counts as empty: no ids, the digests of no bytes. Pre-tokens of any length are
    merged in time n log n. Repeated rows are encoded each; other columns are ignored; an empty table gives
    no rows. remembered: pre-tokens that a worker keeps, which changes its memory and speed alone.
    """
    ranks = read_ranks(path)
    told = _Told(docs.sparkSession.sparkContext.broadcast((ranks, pattern, remembered)), f"{path} {pattern} {remembered}")
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def each(batch):
        tokenizer = _tokenizer(told)
        out: dict = {"doc_id": batch.column(0), "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": []}
        for text in batch.column(1):
            packed = tokenizer.encode_packed(text.as_py())
            ids = array("I", packed)
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(packed).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(tokenizer.decode(ids)).hexdigest())
            if with_ids:
                out["ids"].append(list(ids))
        return out

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), each, T.StructType(fields))

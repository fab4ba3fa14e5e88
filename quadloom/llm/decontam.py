"""Benchmark decontamination by template canonicalisation."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


SEED = 42
#: Words of measure that count as units after a number (fixed values).
UNITS = frozenset("mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs oz gram grams kilogram kilograms ton tons ml l liter liters litre litres s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years kmh mph usd eur dollar dollars cent cents euro euros percent degree degrees celsius fahrenheit w kw kwh v volt volts watt watts hz khz mhz ghz kb mb gb tb".split())
NUMBER_WORDS = frozenset("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
PLAIN, TITLE, NUMBER, UNIT_WORD, MEASURE = 0, 1, 2, 3, 4
NAME_ID, NUMBER_ID, UNIT_ID, MEASURE_ID = (xxhash.xxh64_intdigest(f"<{x}>", SEED) for x in ("name", "number", "unit", "measure"))
ENDING = frozenset(".!?:")
BASE = np.uint64(0x9E3779B97F4A7C15)
FILTER_BITS = 20


@dataclass(frozen=True)
class Settings:
    """window: words of a template window. run: words in a row that make a leak (fewer for shorter items).
    fewest: items with fewer words, two at least, count only word for word as a passage of their own; an item of
    one word is left out, as no match of it would tell anything.
    block, characters: items, and their characters, in one table of windows, which bounds it (an item is never cut)."""

    window: int = 8
    run: int = 13
    fewest: int = 5
    block: int = 20_000
    characters: int = 8_000_000


@dataclass
class Words:
    """The words of a text: hash of each plain form, hash as a template, whether a sentence or line starts there, whether
    it may be either a name or a plain word, and where its plain form is in ``known``."""

    plain: np.ndarray
    ids: np.ndarray
    starts: np.ndarray
    either: np.ndarray
    at: np.ndarray
    known: list[str]

    def form(self, i: int) -> str:
        return self.known[self.at[i]]


class Numbered(dict):
    """Raw words to their numbers; what is known of each number lies in arrays. A bounded cache."""

    def __init__(self, bound: int):
        self.kind, self.plain, self.ends = np.zeros(bound, np.int8), np.zeros(bound, np.uint64), np.zeros(bound, bool)
        self.forms: list[str] = []

    def __missing__(self, raw: str) -> int:
        core = raw if raw.isalnum() else "".join(c for c in raw if c.isalnum())
        low, n = core.lower(), len(self.forms)
        if not core:
            kind = -1
        elif not core.isalpha() and any(map(str.isdigit, core)):
            kind = NUMBER if not any(map(str.isalpha, core)) else MEASURE if core[0].isdigit() else PLAIN
        elif low in NUMBER_WORDS:
            kind = NUMBER
        elif low in UNITS:
            kind = UNIT_WORD
        else:
            kind = TITLE if len(core) > 1 and core[0].isupper() and core[1:].islower() else PLAIN
        if n == len(self.kind):
            self.kind, self.plain, self.ends = (np.concatenate([x, np.zeros_like(x)]) for x in (self.kind, self.plain, self.ends))
        self.kind[n], self.plain[n] = kind, xxhash.xxh64_intdigest(low, SEED)
        self.ends[n] = core is not raw and not ENDING.isdisjoint(raw[-3:])
        self.forms.append(low)
        self[raw] = n
        return n


class Canonical:
    """Texts to words. A cache of over ``bound`` words is given up for a new one between texts."""

    def __init__(self, bound: int = 400_000):
        self.bound, self.cache = bound, Numbered(bound)

    def __call__(self, text: str | None) -> Words:
        if len(self.cache) > self.bound:
            self.cache = Numbered(self.bound)
        cache, raw, lines = self.cache, [], [0]
        for line in (text or "").splitlines():
            raw += line.split()
            lines.append(len(raw))
        n = len(raw)
        at = np.fromiter(map(cache.__getitem__, raw), np.int64, n)
        kind = cache.kind[at]
        starts = np.r_[True, cache.ends[at]][:n]
        starts[[x for x in lines if x < n]] = True
        if n and kind.min() < 0:
            # a start before words that are punctuation only goes on to the next word
            kept = kind >= 0
            part = np.cumsum(starts)[kept]
            starts = np.r_[True, part[1:] != part[:-1]][: len(part)]
            at, kind = at[kept], kind[kept]
            n = len(at)
        plain = cache.plain[at]
        ids, either = plain, np.zeros(n, bool)
        if n and kind.any():
            after = np.r_[False, kind[:-1] == NUMBER]
            title = kind == TITLE
            either = title & starts
            ids = np.where(title & ~starts, np.uint64(NAME_ID), ids)
            ids[kind == NUMBER] = NUMBER_ID
            ids[kind == MEASURE] = MEASURE_ID
            ids[(kind == UNIT_WORD) & after] = UNIT_ID
        return Words(plain, ids, starts, either, at, cache.forms)


def _mixed(sums: np.ndarray) -> np.ndarray:
    return sums ^ (sums >> np.uint64(29))


def _sums(ids: np.ndarray, width: int) -> np.ndarray:
    """Polynomial in BASE of every window; from halves where the width is even."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if width == 1:
        return ids
    half = _sums(ids, width // 2)
    out = half[:n] * np.uint64(pow(int(BASE), width // 2, 1 << 64)) + half[width // 2 : width // 2 + n]
    return out * BASE + ids[width - 1 :] if width % 2 else out


def window_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    return _mixed(_sums(ids, width))


def readings(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of every window: as plain words, and as templates with each word that may be a name read both ways."""
    plain = window_hashes(words.plain, width)
    if words.ids is words.plain and not words.either.any():
        return plain, np.arange(len(plain))
    # windows without a slot are the plain ones
    slots = np.cumsum(np.r_[0, (words.ids != words.plain) | words.either])
    at = np.flatnonzero(slots[width:] > slots[:-width]) if len(plain) else np.zeros(0, int)
    sums = _sums(words.ids, width)[at]
    if words.either.any() and len(plain):
        # what a word adds to a window's sum if it is read as a name, by its place in the window
        change = np.where(words.either, np.uint64(NAME_ID) - words.plain, np.uint64(0))
        power = np.array([pow(int(BASE), width - 1 - i, 1 << 64) for i in range(width)], np.uint64)
        for i in range(width):
            here = words.either[at + i]
            if here.any():
                # once more with this word as a name
                sums, at = np.concatenate([sums, sums[here] + change[at[here] + i] * power[i]]), np.concatenate([at, at[here]])
    return np.concatenate([plain, _mixed(sums)]), np.concatenate([np.arange(len(plain)), at])


SLOTS = frozenset((NAME_ID, NUMBER_ID, UNIT_ID, MEASURE_ID))
SLOT_IDS = np.fromiter(SLOTS, np.uint64, len(SLOTS))


class Matcher:
    """The hash table of all windows, plain and as templates, of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]], settings: Settings):
        canonical, self.settings = Canonical(), settings
        self.items: dict[int, Words] = {}
        self.table: dict[int, dict[int, set[tuple[int, int]]]] = {}
        for nth, (_, text) in enumerate(items):
            words = canonical(text)
            if len(words.ids) > 1:
                self.items[nth] = words
                width = min(settings.window, len(words.ids))
                # of items under the fewest words only the plain form counts
                hashes, places = readings(words, width) if len(words.ids) >= settings.fewest else (window_hashes(words.plain, width), np.zeros(1, int))
                for h, at in zip(hashes.tolist(), places.tolist(), strict=True):
                    self.table.setdefault(width, {}).setdefault(h, set()).add((nth, at))
        self.names = [i for i, _ in items]
        self.filters = {}
        for width, windows in self.table.items():
            bits = np.zeros(1 << FILTER_BITS, bool)
            bits[(np.fromiter(windows, np.uint64, len(windows)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
            self.filters[width] = bits

    def consistent(self, doc: Words, start: int, item: int, at: int, length: int) -> bool:
        """Whether every slot value of the item's words stands for one value in the document, and the other way round.

        A word that may be a name and is the same on both sides sets no pair, but must not be against one.
        """
        mine = self.items[item]
        there: dict[tuple, str] = {}
        back: dict[tuple, str] = {}
        loose = []
        for d, i in zip(range(start, start + length), range(at, at + length), strict=True):
            kind = next((int(x) for x in (doc.ids[d], mine.ids[i]) if int(x) in SLOTS), NAME_ID if doc.either[d] and mine.either[i] else 0)
            if not kind:
                continue
            a, b = mine.form(i), doc.form(d)
            if a == b and (doc.either[d] or mine.either[i] or doc.ids[d] != mine.ids[i]):
                loose.append((kind, a))
            elif there.setdefault((kind, a), b) != b or back.setdefault((kind, b), a) != a:
                return False
        return all(there.get(x, x[1]) == x[1] and back.get(x, x[1]) == x[1] for x in loose)

    def find(self, canonical: Canonical, text: str | None) -> dict[int, int]:
        """Words in a row shared with each leaked item, by item id: the longest run of matching words on one alignment."""
        doc = canonical(text)
        out: dict[int, int] = {}
        for width, windows in self.table.items():
            hashes, places = readings(doc, width)
            hits: dict[tuple[int, int], set[int]] = {}
            for nth in np.flatnonzero(self.filters[width][(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]).tolist():
                pos = int(places[nth])
                for item, at in windows.get(int(hashes[nth]), ()):
                    hits.setdefault((item, pos - at), set()).add(pos)
            for (item, shift), seeds in hits.items():
                best = self._longest(doc, item, shift, seeds, width)
                if best:
                    out[self.names[item]] = max(best, out.get(self.names[item], 0))
        return out

    def _longest(self, doc: Words, item: int, shift: int, seeds: set[int], width: int) -> int:
        """Words of the longest run around a seed that counts as a leak, 0 if none does."""
        mine = self.items[item]
        need = min(self.settings.run, len(mine.ids))
        first, end = max(0, shift), min(len(doc.ids), shift + len(mine.ids))
        d, i = slice(first, end), slice(first - shift, end - shift)
        same = doc.plain[d] == mine.plain[i]
        if len(mine.ids) < self.settings.fewest:
            # the item must be a passage of its own, between ends of sentences or lines
            return len(mine.ids) if same.all() and len(same) == len(mine.ids) and doc.starts[first] and (end == len(doc.ids) or doc.starts[end]) else 0
        names = (doc.either[d] | (doc.ids[d] == NAME_ID)) & (mine.either[i] | (mine.ids[i] == NAME_ID))
        slot = names | (doc.ids[d] == mine.ids[i]) & np.isin(doc.ids[d], SLOT_IDS)
        match = same | slot
        edges = np.flatnonzero(np.diff(np.r_[False, match, False].astype(np.int8)))
        best = 0
        for low, high in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if high - low < max(need, best + 1) or not any(first + low <= s <= first + high - width for s in seeds):
                continue
            # words that may be names and are the same count as plain words
            filled = slot & ~(same & (doc.either[d] | mine.either[i]))
            for k in range(low, high - need + 1):
                if same[k : k + need].all() or (2 * filled[k : k + need].sum() <= need and self.consistent(doc, first + k, item, first + k - shift, need)):
                    best = high - low
                    break
        return best


def _blocks(benchmark: DataFrame, settings: Settings):
    """Items in blocks of bounded number and length."""
    block: list[tuple[int, str]] = []
    size = 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").toLocalIterator():
        block.append((r.item_id, r.text))
        size += len(r.text)
        if len(block) == settings.block or size >= settings.characters:
            yield block
            block, size = [], 0
    if block:
        yield block


def _matches(text: Column, block: list, settings: Settings) -> Column:
    ready: list = []

    @F.pandas_udf("array<struct<item_id: long, words: int>>")
    def found(texts: pd.Series) -> pd.Series:
        if not ready:
            ready.extend((Matcher(block, settings), Canonical()))
        matcher, canonical = ready
        return pd.Series([[{"item_id": i, "words": n} for i, n in sorted(matcher.find(canonical, t).items())] for t in texts], dtype=object)

    return found(text)


def leaks(text: Column, benchmark: DataFrame, settings: Settings = Settings()) -> Column:
    """array of (item_id, words) of the benchmark items that a text holds; empty for null texts and an empty benchmark.

    Each block of items is hashed into one table that goes to all tasks; a larger benchmark takes more
    blocks, each of the same bound. No document is shuffled, so a passage in very many of them costs no
    more than another.
    """
    out = None
    for block in _blocks(benchmark, settings):
        this = _matches(text, block, settings)
        out = this if out is None else F.concat(out, this)
    return F.array().cast("array<struct<item_id: long, words: int>>") if out is None else out


def decontaminate(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, contaminated, item_ids (sorted), longest (words in a row); one row per input row.

    Templates: words in lower case without punctuation, numbers, names (capitalised inside a sentence)
    and units as typed placeholders; a capitalised word that begins a sentence or a line is read both as
    a name and as a plain word. A leak is a run of matching words on one alignment of at least ``run``
    words, or the whole item if shorter, that is the item's word for word, or whose slots map one to one
    and fill at most half of it. Windows come from whole texts. Repeated items are each reported.
    """
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), leaks(F.col("text"), benchmark, settings).alias("m"))
    return found.select("doc_id", (F.size("m") > 0).alias("contaminated"), F.array_sort(F.array_distinct(F.transform("m", lambda x: x["item_id"]))).alias("item_ids"), F.coalesce(F.array_max(F.transform("m", lambda x: x["words"])), F.lit(0)).alias("longest"))

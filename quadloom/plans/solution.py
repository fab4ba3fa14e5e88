"""Bags of solutions and the joins between them."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.functions.terms import BOXED, Kind, Value, box


def column_name(var: str) -> str:
    """Spark does not tell a from A: capitals are marked."""
    return var if var == var.lower() else var.lower() + "~" + "".join(str(i) + "." for i, c in enumerate(var) if c.isupper())


def col(df: DataFrame, var: str) -> Column:
    return df[f"`{column_name(var)}`"]


@dataclass
class Solution:
    """One nullable column for each variable; null is unbound. certain: variables bound in every row."""

    df: DataFrame
    kinds: dict[str, Kind]
    certain: set[str] = field(default_factory=set)

    def value(self, var: str) -> Value:
        return Value(col(self.df, var), self.kinds[var])

    def values(self) -> dict[str, Value]:
        return {v: self.value(v) for v in self.kinds}

    def select(self, columns: dict[str, Value], certain: set[str] | None = None) -> Solution:
        df = self.df.select(*[v.col.alias(column_name(n)) for n, v in columns.items()])
        return Solution(df, {n: v.kind for n, v in columns.items()}, (self.certain if certain is None else certain) & set(columns))

    def keep(self, names: list[str]) -> Solution:
        return self.select({n: self.value(n) for n in names if n in self.kinds})

    def where(self, condition: Column) -> Solution:
        return Solution(self.df.where(condition), self.kinds, self.certain)

    def boxed(self, names: set[str]) -> Solution:
        """The same with the named variables boxed."""
        if all(self.kinds[n] == BOXED for n in names):
            return self
        return self.select({n: Value(box(v), BOXED) if n in names else v for n, v in self.values().items()})

    def tagged(self, tag: str) -> Solution:
        """Every column renamed, so that both sides of a join can be told apart."""
        return self.select({f"{n}{tag}": v for n, v in self.values().items()}, {f"{n}{tag}" for n in self.certain})

    def distinct(self) -> Solution:
        return Solution(self.df.distinct(), self.kinds, self.certain)


def aligned(a: Solution, b: Solution) -> tuple[Solution, Solution, list[str]]:
    """Both with the same kind for each shared variable, and the shared variables."""
    shared = [n for n in a.kinds if n in b.kinds]
    odd = {n for n in shared if a.kinds[n] != b.kinds[n]}
    return a.boxed(odd), b.boxed(odd), shared


TAG = "~r"


def _compatible(a: Solution, b: Solution, shared: list[str]) -> Column:
    """Equality where both sides always bind; else a mapping may be unbound on either side."""
    out = F.lit(True)
    for n in shared:
        x, y = a.value(n).col, b.value(n + TAG).col
        out = out & ((x == y) if n in a.certain and n + TAG in b.certain else (x.isNull() | y.isNull() | (x == y)))
    return out


def _masks(s: Solution, names: list[str]) -> list[tuple[frozenset[str], Solution]]:
    """The rows of s by which of the names they bind; a name that is certain is bound in all."""
    out = [(frozenset(), s)]
    for n in names:
        bound = lambda p, n=n: Solution(p.df.where(p.value(n).col.isNotNull()), p.kinds, p.certain | {n})
        if n in s.certain:
            out = [(have | {n}, p) for have, p in out]
        else:
            out = [x for have, p in out for x in ((have | {n}, bound(p)), (have, p.where(p.value(n).col.isNull())))]
    return out


def _splits(a: Solution, b: Solution, shared: list[str]) -> bool:
    """Whether no shared variable is certain on both sides, so that no equality would be left to join by."""
    return bool(shared) and not any(n in a.certain and n + TAG in b.certain for n in shared) and len(shared) <= 4


def _equal(a: Solution, b: Solution, names: list[str]) -> Column | None:
    out = None
    for n in names:
        one = a.value(n).col == b.value(n + TAG).col
        out = one if out is None else out & one
    return out


def _inner(a: Solution, b: Solution, shared: list[str], condition: Column | None = None) -> DataFrame:
    """Compatible pairs. Where no shared variable is certain, the rows of each side go by what they bind, and each two
    parts join by what both bind; only rows that share no bound variable meet as a product, as they must."""
    if not _splits(a, b, shared):
        on = _compatible(a, b, shared) if shared else None
        on = condition if on is None else on if condition is None else on & condition
        return a.df.crossJoin(b.df) if on is None else a.df.join(b.df, on, "inner")
    out = None
    for have, x in _masks(a, shared):
        for there, y in _masks(b, [n + TAG for n in shared]):
            on = _equal(x, y, [n for n in shared if n in have and n + TAG in there])
            on = condition if on is None else on if condition is None else on & condition
            part = x.df.crossJoin(y.df) if on is None else x.df.join(y.df, on, "inner")
            out = part if out is None else out.unionByName(part)
    return out


def _semi(a: Solution, b: Solution, shared: list[str], negated: bool, condition: Column | None = None, sharing: bool = False) -> DataFrame:
    """Rows of a with (or without) a compatible row of b; with ``sharing``, one that binds a variable both bind."""
    if not _splits(a, b, shared):
        on = _compatible(a, b, shared) if shared else F.lit(True)
        if sharing and not any(n in a.certain and n + TAG in b.certain for n in shared):
            on = on & reduce(Column.__or__, [a.value(n).col.isNotNull() & b.value(n + TAG).col.isNotNull() for n in shared])
        return a.df.join(b.df, on if condition is None else on & condition, "left_anti" if negated else "left_semi")
    out = None
    for have, x in _masks(a, shared):
        part, rest = None, x.df
        for there, y in _masks(b, [n + TAG for n in shared]):
            both = [n for n in shared if n in have and n + TAG in there]
            if sharing and not both:
                continue
            on, right = _equal(x, y, both), y.df
            if on is None and condition is None:
                # any row will do
                on, right = F.lit(True), right.limit(1)
            else:
                on = on if condition is None else condition if on is None else on & condition
            if not negated:
                # each part sees only the rows without a partner in those before, as this is a bag
                found = rest.join(right, on, "left_semi")
                part = found if part is None else part.unionByName(found)
            rest = rest.join(right, on, "left_anti")
        part = rest if negated else part
        out = part if out is None else out.unionByName(part)
    return out


def _merged(joined: DataFrame, a: Solution, b: Solution, shared: list[str]) -> dict[str, Value]:
    out = {n: Value(joined[f"`{column_name(n)}`"], k) for n, k in a.kinds.items()}
    for n, k in b.kinds.items():
        name, c = n.removesuffix(TAG), joined[f"`{column_name(n)}`"]
        if name in shared:
            if name not in a.certain:
                out[name] = Value(F.coalesce(out[name].col, c), k)
        else:
            out[name] = Value(c, k)
    return out


def join(a: Solution, b: Solution) -> Solution:
    a, b, shared = aligned(a, b)
    b = b.tagged(TAG)
    joined = _inner(a, b, shared)
    values = _merged(joined, a, b, shared)
    return Solution(joined, {}, set()).select(values, a.certain | {n.removesuffix(TAG) for n in b.certain})


def left_join(a: Solution, b: Solution, condition=None) -> Solution:
    """condition: from the merged values to a column, or None; a row without a partner keeps b's variables unbound."""
    a, b, shared = aligned(a, b)
    b = b.tagged(TAG)
    on = None
    if condition is not None:
        seen = a.values() | {n.removesuffix(TAG): v for n, v in b.values().items() if n.removesuffix(TAG) not in a.kinds}
        for n in shared:
            if n not in a.certain:
                seen[n] = Value(F.coalesce(a.value(n).col, b.value(n + TAG).col), a.kinds[n])
        on = condition(seen)
    if _splits(a, b, shared):
        joined = _inner(a, b, shared, on).unionByName(_semi(a, b, shared, True, on), allowMissingColumns=True)
    else:
        both = _compatible(a, b, shared)
        joined = a.df.join(b.df, both if on is None else both & on, "left")
    return Solution(joined, {}, set()).select(_merged(joined, a, b, shared), set(a.certain))


def semi_join(a: Solution, b: Solution, negated: bool, condition=None) -> Solution:
    """EXISTS and NOT EXISTS."""
    x, y, shared = aligned(a, b)
    y = y.tagged(TAG)
    on = condition(y_values(y) | x.values()) if condition is not None else None
    return Solution(_semi(x, y, shared, negated, on), x.kinds, x.certain)


def y_values(b: Solution) -> dict[str, Value]:
    return {n.removesuffix(TAG): v for n, v in b.values().items()}


def minus(a: Solution, b: Solution) -> Solution:
    """Rows of a without a compatible row of b that shares a bound variable."""
    a2, b2, shared = aligned(a, b)
    if not shared:
        return a
    b2 = b2.tagged(TAG)
    return Solution(_semi(a2, b2, shared, True, sharing=True), a2.kinds, a2.certain)


def union(parts: list[Solution]) -> Solution:
    names = list(dict.fromkeys(n for p in parts for n in p.kinds))
    kinds = {}
    for n in names:
        own = {p.kinds[n] for p in parts if n in p.kinds}
        kinds[n] = own.pop() if len(own) == 1 else BOXED
    out = None
    types: dict[str, str] = {}
    for p in parts:
        for n in p.kinds:
            if p.kinds[n] == kinds[n]:
                types.setdefault(n, p.df.select(col(p.df, n)).schema[0].dataType.simpleString())
    from quadloom.functions.terms import BOX

    for p in parts:
        p = p.boxed({n for n in p.kinds if kinds[n] == BOXED})
        values = {n: p.value(n) if n in p.kinds else Value(F.lit(None).cast(types.get(n, BOX)), kinds[n]) for n in names}
        df = p.select(values).df
        out = df if out is None else out.unionByName(df)
    certain = set.intersection(*[p.certain for p in parts]) if parts else set()
    return Solution(out, kinds, certain)

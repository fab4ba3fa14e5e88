"""Graphs that answer triple patterns: tables of quads, and relational tables mapped to triples."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadloom.functions.terms import (
    BOX,
    BOXED,
    K_IRI,
    K_TRIPLE,
    Kind,
    Value,
    box,
    boxed_constant,
    constant,
    equal,
    lexical,
    same_term,
    struct,
    triple_part,
)
from quadloom.plans.solution import Solution, column_name, join, union
from quadloom.sparql.ast import RDF, BNode, IRI, Lit, Triple, TripleTerm, Var

TYPE = RDF + "type"
QUADS = f"g string, s {BOX}, p string, o {BOX}"


def variable(term) -> str | None:
    """The name under which a variable or a pattern's blank node is bound."""
    return term.name if isinstance(term, Var) else f"_:{term.v}" if isinstance(term, BNode) else None


def bind(df: DataFrame, parts: list[tuple[object, Value]]) -> Solution:
    """The rows of df whose parts match the given terms, with their variables bound."""
    values: dict[str, Value] = {}
    condition = F.lit(True)
    work = list(parts)
    while work:
        term, value = work.pop(0)
        name = variable(term)
        if isinstance(term, TripleTerm):
            b = box(value)
            condition = condition & (b["k"] == K_TRIPLE)
            work += [(term.s, Value(triple_part(b, 0), BOXED)), (term.p, Value(triple_part(b, 1)["v"], Kind("iri"))), (term.o, Value(triple_part(b, 2), BOXED))]
        elif name is None:
            condition = condition & _is(value, term)
        elif name in values:
            one = values[name]
            condition = condition & (one.col == value.col if one.kind == value.kind else same_term(box(one), box(value)))
        else:
            values[name] = value
            condition = condition & value.col.isNotNull()
    return Solution(df.where(condition), {}, set()).select(values, set(values))


def _is(value: Value, term) -> Column:
    """Whether a value is a ground term, by identity, in a form that can be pushed to the scan."""
    kind = value.kind
    if kind.name == "iri":
        if not isinstance(term, IRI) or not term.v.startswith(kind.prefix):
            return F.lit(False)
        return value.col.cast("string") == term.v[len(kind.prefix) :] if not kind.prefix else value.col == F.lit(term.v[len(kind.prefix) :]).try_cast("string")
    if kind.name == "box":
        b, t = value.col, boxed_constant(term)
        return (b["v"] == t["v"]) & same_term(b, t)
    if not isinstance(term, Lit):
        return F.lit(False)
    own = constant(term)
    # another lexical form is another term; doubles are taken by value, as columns hold no lexical form
    if own.kind != kind or own.own is not None and kind.name != "double":
        return F.lit(False)
    return equal(value, own)


class QuadGraph:
    """A table (g string, s box, p string, o box) without repeated rows; g is '' in the default graph."""

    def __init__(self, quads: DataFrame, default_union: bool = False, default: list[str] | None = None, named: list[str] | None = None):
        self.quads, self.default_union, self.default, self.named = quads, default_union, default, named
        self.spark: SparkSession = quads.sparkSession

    @staticmethod
    def of(spark: SparkSession, triples: list) -> QuadGraph:
        """From (graph or None, triple) pairs of ground terms."""
        return QuadGraph(quads_frame(spark, triples))

    def dataset(self, default: list[str], named: list[str]) -> QuadGraph:
        return QuadGraph(self.quads, False, default, named) if default or named else self

    def stars(self, triples: list[Triple]) -> list[list[Triple]]:
        return [[t] for t in triples]

    def scan(self, triples: list[Triple], graph=None) -> Solution:
        (t,) = triples
        q = self.quads
        parts = [(t.s, Value(q["s"], BOXED)), (t.p, Value(q["p"], Kind("iri"))), (t.o, Value(q["o"], BOXED))]
        if graph is None:
            if self.default is not None:
                q = q.where(F.col("g").isin(self.default or [""]) if self.default else F.lit(False)).select(F.lit("").alias("g"), "s", "p", "o").distinct()
            elif self.default_union:
                q = q.select("s", "p", "o").distinct()
            else:
                q = q.where("g = ''")
        else:
            q = q.where("g <> ''")
            if self.named is not None:
                q = q.where(F.col("g").isin(self.named)) if self.named else q.where("false")
            parts.append((graph, Value(q["g"], Kind("iri"))))
        parts = [(term, Value(q[name], v.kind)) for (term, v), name in zip(parts, ("s", "p", "o", "g"), strict=False)]
        return bind(q, parts)

    def nodes(self, graph=None) -> Solution:
        """Every subject and object, once, as ?node."""
        both = union([self.scan([Triple(Var("node"), Var("p"), Var("x"))], graph).keep(["node"]), self.scan([Triple(Var("x"), Var("p"), Var("node"))], graph).keep(["node"])])
        return both.distinct()

    def graphs(self) -> list[str]:
        return sorted(r.g for r in self.quads.where("g <> ''").select("g").distinct().collect())


def quads_frame(spark: SparkSession, triples: list) -> DataFrame:
    """A small table of ground (graph, triple) pairs."""
    from quadloom.sources.ntriples import nquads_rows

    text = spark.createDataFrame([(line,) for line in dict.fromkeys(ground_text(g, t) for g, t in triples)], "value string")
    return nquads_rows(text)


def term_text(term) -> str:
    if isinstance(term, IRI):
        return f"<{term.v}>"
    if isinstance(term, BNode):
        return f"_:{term.v}"
    if isinstance(term, TripleTerm):
        return f"<<( {term_text(term.s)} {term_text(term.p)} {term_text(term.o)} )>>"
    quoted = term.v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
    if term.lang:
        return f'"{quoted}"@{term.lang.lower()}' + (f"--{term.dir}" if term.dir else "")
    return f'"{quoted}"' if term.dt.endswith("#string") and "XMLSchema" in term.dt else f'"{quoted}"^^<{term.dt}>'


def ground_text(graph, t: Triple) -> str:
    return " ".join([term_text(t.s), term_text(t.p), term_text(t.o), *([term_text(graph)] if graph is not None else []), "."])


@dataclass(frozen=True)
class Mapped:
    """A predicate of a mapped table: its column, and the IRI prefix if the column is a reference, or its language column."""

    predicate: str
    column: str
    refers: str | None = None
    language: str | None = None


@dataclass
class TableMap:
    """Each row of ``table`` is a subject prefix + key; key is a column, or an expression over several."""

    table: str
    prefix: str
    key: str
    columns: list[Mapped]
    type: str | None = None
    graph: str | None = None  # prefix of a graph per value of graph_column
    graph_column: str | None = None
    by_predicate: dict[str, Mapped] = field(init=False)

    def __post_init__(self):
        self.by_predicate = {m.predicate: m for m in self.columns}


LITERALS = {T.ByteType: "integer", T.ShortType: "integer", T.IntegerType: "integer", T.LongType: "integer", T.DoubleType: "double", T.FloatType: "double", T.StringType: "string", T.BooleanType: "boolean", T.TimestampType: "dateTime", T.TimestampNTZType: "dateTime", T.DateType: "date", T.DecimalType: "decimal"}


class Narrowed(list):
    """Patterns whose subject can only be a row of tables with certain prefixes."""

    def __init__(self, triples: list[Triple], prefixes: set[str]):
        super().__init__(triples)
        self.prefixes = prefixes


class MappedGraph:
    """Relational tables as a virtual graph. Patterns on one subject and table are one scan of just their columns."""

    def __init__(self, spark: SparkSession, load: Callable[[str], DataFrame], maps: list[TableMap], default: list[str] | None = None, named: list[str] | None = None):
        self.spark, self.load, self.maps, self.default, self.named = spark, load, maps, default, named

    def dataset(self, default: list[str], named: list[str]) -> MappedGraph:
        """Of FROM and FROM NAMED: the rows of the graphs listed. A row lies in one graph, so their merge has no repeats."""
        return MappedGraph(self.spark, self.load, self.maps, default, named) if default or named else self

    def as_quads(self, only: set[str] | None = None, without: set[str] = frozenset()) -> QuadGraph:
        """All triples, or those of some predicates, as one table of quads, with those of named graphs."""
        names = {c.predicate for m in self.maps for c in m.columns} | {TYPE}
        out = None
        for p in sorted((names if only is None else names & only) - without):
            for graph in (None, Var("g")):
                if graph is not None and not any(m.graph for m in self._tables(Triple(Var("s"), IRI(p), Var("o")))):
                    continue
                x = self.scan([Triple(Var("s"), IRI(p), Var("o"))], graph)
                name = F.lit("") if graph is None else lexical(x.value("g"))
                own = x.df.select(name.alias("g"), box(x.value("s")).alias("s"), F.lit(p).alias("p"), box(x.value("o")).alias("o"))
                out = own if out is None else out.unionByName(own)
        return QuadGraph(self.spark.createDataFrame([], QUADS) if out is None else out)

    def _tables(self, t: Triple) -> list[TableMap]:
        if isinstance(t.p, IRI):
            return [m for m in self.maps if t.p.v in m.by_predicate or (t.p.v == TYPE and m.type and (not isinstance(t.o, IRI) or t.o.v == m.type))]
        return self.maps

    def stars(self, triples: list[Triple]) -> list[list[Triple]]:
        """Triples of one subject and one table together; a type pattern joins the star of its table."""
        out: dict[tuple, list[Triple]] = {}
        # the fixed predicates of a subject tell which rows it can be; an open predicate of it looks only there
        prefixes: dict[str, set[str]] = {}
        for t in triples:
            if isinstance(t.p, IRI):
                own = {m.prefix for m in self._tables(t)}
                prefixes[str(t.s)] = prefixes.get(str(t.s), own) & own
        for i, t in enumerate(triples):
            tables = self._tables(t)
            if not isinstance(t.p, IRI) and str(t.s) in prefixes:
                out[(i,)] = Narrowed([t], prefixes[str(t.s)])
                continue
            own = (str(t.s), tables[0].table) if len(tables) == 1 and isinstance(t.p, IRI) else (i,)
            out.setdefault(own, []).append(t)
        return list(out.values())

    def scan(self, triples: list[Triple], graph=None) -> Solution:
        tables = [m for m in self._tables(triples[0]) if not isinstance(triples, Narrowed) or m.prefix in triples.prefixes]
        parts = [self._scan_table(m, triples, graph) for m in tables] if tables else []
        parts = [p for p in parts if p is not None]
        if parts:
            return parts[0] if len(parts) == 1 else union(parts)
        names = list(dict.fromkeys(n for t in triples for x in (t.s, t.p, t.o) if (n := variable(x))))
        empty = self.spark.createDataFrame([], ", ".join(f"`{column_name(n)}` {BOX}" for n in names) or "none int")
        return Solution(empty, dict.fromkeys(names, BOXED), set(names))

    def _scan_table(self, m: TableMap, triples: list[Triple], graph) -> Solution | None:
        if graph is not None and not m.graph or isinstance(triples[0].s, IRI) and not triples[0].s.v.startswith(m.prefix):
            return None
        df = self.load(m.table)
        only = self.default if graph is None else self.named
        if only is not None:
            if not m.graph:
                return None
            df = df.where(F.col(m.graph_column).cast("string").isin([g[len(m.graph) :] for g in only if g.startswith(m.graph)]) if only else F.lit(False))
        where = [(graph, Value(df[m.graph_column], Kind("iri", m.graph)))] if graph is not None else []
        parts = [(triples[0].s, Value(F.expr(m.key), Kind("iri", m.prefix)))]
        if isinstance(triples[0].p, IRI):
            for t in triples:
                if t.p.v == TYPE and TYPE not in m.by_predicate:
                    parts.append((t.o, Value(F.lit(m.type), Kind("iri"))))
                else:
                    parts.append((t.o, self._object(df, m.by_predicate[t.p.v])))
            return bind(df, parts + where)
        t = triples[0]
        options = [bind(df, [*parts, (t.p, Value(F.lit(c.predicate), Kind("iri"))), (t.o, Value(box(self._object(df, c)), BOXED)), *where]) for c in m.columns]
        if m.type:
            options.append(bind(df, [*parts, (t.p, Value(F.lit(TYPE), Kind("iri"))), (t.o, Value(struct(K_IRI, m.type), BOXED)), *where]))
        return union(options)

    def _object(self, df: DataFrame, c: Mapped) -> Value:
        column = df[c.column]
        if c.refers is not None:
            return Value(column, Kind("iri", c.refers))
        if c.language:
            lang = df[c.language]
            return Value(F.when(column.isNotNull(), F.when(lang.isNotNull(), struct(3, column, RDF + "langString", F.lower(lang))).otherwise(struct(3, column, "http://www.w3.org/2001/XMLSchema#string"))), BOXED)
        name = LITERALS[type(df.schema[c.column].dataType)]
        return Value(column.cast("bigint") if name == "integer" else column.cast("double") if name == "double" else column.cast("timestamp") if name == "dateTime" else column, Kind(name))

    def nodes(self, graph=None) -> Solution:
        one = self.scan([Triple(Var("s"), Var("p"), Var("o"))], graph)
        node = lambda n: Solution(one.df, one.kinds, one.certain).select({"node": Value(box(one.value(n)), BOXED)}, {"node"})
        return union([node("s"), node("o")]).distinct()


__all__ = ["Mapped", "MappedGraph", "QuadGraph", "TableMap", "bind", "ground_text", "join", "quads_frame", "term_text", "variable"]

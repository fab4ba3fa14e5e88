"""A graph or dataset as a value: every change gives a new one."""

from __future__ import annotations

import json
from collections.abc import Callable
from copy import deepcopy
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.functions.terms import BOXED, Kind, Value
from quadloom.operators import setops
from quadloom.plans.engine import Engine
from quadloom.sources import ntriples, turtle
from quadloom.sources.graphs import QUADS, QuadGraph, _is, quads_frame
from quadloom.sparql.ast import IRI, Triple, Var

class NotUnique(ValueError):
    pass


class RdfGraph:
    """Quads with prefixes. Terms are given as syntax-tree terms; None is a wildcard."""

    def __init__(self, spark: SparkSession, quads: DataFrame | None = None, prefixes: dict[str, str] | None = None, default_union: bool = False):
        self.spark, self.prefixes, self.default_union = spark, dict(prefixes or {}), default_union
        self.quads = quads if quads is not None else spark.createDataFrame([], QUADS)

    def _with(self, quads: DataFrame) -> RdfGraph:
        return RdfGraph(self.spark, quads, self.prefixes, self.default_union)

    @property
    def engine(self) -> Engine:
        return Engine(QuadGraph(self.quads, self.default_union), self.prefixes)

    # reading and writing
    @staticmethod
    def format_of(path: str) -> str:
        return turtle.format_of(path)

    def parse(self, source: str | None = None, data: str | None = None, format: str | None = None, graph: str = "", base: str = "") -> RdfGraph:
        """With the triples of a file or text. N-Triples and N-Quads are read by all executors; Turtle and TriG by the driver, as a document is one unit."""
        if source is not None:
            read = turtle.read(self.spark, source, self.prefixes, format, base)
        else:
            read = turtle.parsed(self.spark, data, format or "turtle", self.prefixes, base)
        if graph:
            read = read.withColumn("g", F.when(F.col("g") == "", graph).otherwise(F.col("g")))
        return self._with(setops.graph_union(self.quads, read))

    def serialize(self, path: str | None = None, format: str = "nquads") -> str | None:
        """To a folder of N-Quads, or as Turtle or TriG text of a small graph."""
        if format in ("nt", "nquads"):
            if path:
                ntriples.write(self.quads, path)
                return None
            return "\n".join(sorted(r.value for r in ntriples.lines(self.quads).collect())) + "\n"
        text = turtle.write(self.quads, self.prefixes, trig=format == "trig")
        if path:
            Path(path).write_text(text)
            return None
        return text

    # patterns
    def match(self, s=None, p=None, o=None, g=None) -> DataFrame:
        """The quads that match; g: an IRI, None for all graphs, '' for the default graph."""
        q = self.quads if g is None else self.quads.where(F.col("g") == (g if isinstance(g, str) else g.v))
        for name, term, kind in (("s", s, BOXED), ("p", p, Kind("iri")), ("o", o, BOXED)):
            if term is not None:
                q = q.where(_is(Value(q[name], kind), term))
        return q

    def subjects(self, p=None, o=None) -> DataFrame:
        return self.match(None, p, o).select("s").distinct()

    def predicates(self, s=None, o=None) -> DataFrame:
        return self.match(s, None, o).select("p").distinct()

    def objects(self, s=None, p=None) -> DataFrame:
        return self.match(s, p).select("o").distinct()

    def predicate_objects(self, s) -> DataFrame:
        return self.match(s).select("p", "o").distinct()

    def subject_objects(self, p) -> DataFrame:
        return self.match(None, p).select("s", "o").distinct()

    def subject_predicates(self, o) -> DataFrame:
        return self.match(None, None, o).select("s", "p").distinct()

    def value(self, s, p, default=None, any: bool = True):
        """One object of a subject and predicate; without ``any``, several are an error."""
        found = self.objects(s, p).limit(2).collect()
        if len(found) > 1 and not any:
            raise NotUnique(f"{s} has several values of {p}")
        return found[0].o if found else default

    def __contains__(self, t: Triple) -> bool:
        return not self.match(t.s, t.p, t.o).isEmpty()

    def __len__(self) -> int:
        return self.quads.count()

    # changes
    def add(self, *triples: Triple, graph: str | None = None) -> RdfGraph:
        new = quads_frame(self.spark, [(IRI(graph) if graph else None, t) for t in triples])
        return self._with(setops.graph_union(self.quads, new))

    def remove(self, s=None, p=None, o=None, g=None) -> RdfGraph:
        return self._with(setops.graph_difference(self.quads, self.match(s, p, o, g)))

    def update(self, text: str) -> RdfGraph:
        return self._with(self.engine.update(text).quads)

    # named graphs
    def graph_names(self) -> list[str]:
        return QuadGraph(self.quads).graphs()

    def has_graph(self, name: str) -> bool:
        return not self.quads.where(F.col("g") == name).isEmpty()

    def graph(self, name: str) -> RdfGraph:
        return self._with(self.quads.where(F.col("g") == name).withColumn("g", F.lit("")))

    def remove_graph(self, name: str) -> RdfGraph:
        return self._with(self.quads.where(F.col("g") != name))

    def merged(self) -> RdfGraph:
        """All graphs as one set of triples."""
        return self._with(self.quads.select(F.lit("").alias("g"), "s", "p", "o").distinct())

    def overlap(self) -> DataFrame:
        """Triples in more than one graph, with their number."""
        return self.quads.groupBy("s", "p", "o").agg(F.count("*").alias("n")).where("n > 1")

    # set operations
    def __add__(self, other: RdfGraph) -> RdfGraph:
        return self._with(setops.graph_union(self.quads, other.quads))

    def __and__(self, other: RdfGraph) -> RdfGraph:
        return self._with(setops.graph_intersection(self.quads, other.quads))

    def __sub__(self, other: RdfGraph) -> RdfGraph:
        return self._with(setops.graph_difference(self.quads, other.quads))

    def __xor__(self, other: RdfGraph) -> RdfGraph:
        return self._with(setops.graph_symmetric_difference(self.quads, other.quads))

    # queries
    def query(self, text: str, bindings: dict[str, object] | None = None):
        """A DataFrame for SELECT, a graph for CONSTRUCT and DESCRIBE, a truth value for ASK. bindings: variables fixed to terms, in every group."""
        from quadloom.sparql.parser import parse_query

        return self._answer(substituted(parse_query(text, self.prefixes), bindings or {}))

    def _answer(self, q):
        if q.form == "ASK":
            return self.engine.ask(q)
        if q.form in ("CONSTRUCT", "DESCRIBE"):
            return self._with(self.engine.construct(q))
        return self.engine.select(q)

    def prepare(self, text: str) -> Callable:
        """A query parsed once, to be run with bindings on this graph or another."""
        from quadloom.sparql.parser import parse_query

        parsed = parse_query(text, self.prefixes)

        def run(bindings: dict[str, object] | None = None, graph: RdfGraph | None = None):
            return (graph or self)._answer(substituted(deepcopy(parsed), bindings or {}))

        return run

    def path(self, path: str, start=None) -> DataFrame:
        """(s, o): the pairs that a property path joins, a bag, or those from a start."""
        from quadloom.sparql.parser import parse_query

        q = parse_query(f"SELECT * {{ ?s {path} ?o }}", self.prefixes)
        return self._answer(substituted(q, {"s": start}) if start is not None else q).select(*([] if start is not None else ["s"]), "o")

    def result_lines(self, text: str, form: str = "tsv") -> DataFrame:
        """(value): the rows of a SELECT query as lines of CSV (plain texts) or TSV (terms), made by all executors; the header is apart."""
        from quadloom.functions.terms import box, nt_text
        from quadloom.sparql.parser import parse_query

        s = self.engine.solutions(parse_query(text, self.prefixes))
        boxed = [box(Value(s.value(n).col, k)) for n, k in s.kinds.items()]
        if form == "tsv":
            return s.df.select(F.concat_ws("\t", *[F.coalesce(nt_text(b), F.lit("")) for b in boxed]).alias("value"))
        if form != "csv":
            raise ValueError(f"no lines of {form}")
        plain = [F.coalesce(F.when(b["k"] == 1, F.concat(F.lit("_:"), b["v"])).otherwise(b["v"]), F.lit("")) for b in boxed]
        quoted = [F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c) for c in plain]
        return s.df.select(F.concat_ws(",", *quoted).alias("value"))

    def results_json(self, text: str) -> str:
        """SPARQL JSON results of a SELECT or ASK query, for results that fit the driver."""
        from quadloom.functions.terms import Value, box
        from quadloom.sparql.parser import parse_query

        q = parse_query(text, self.prefixes)
        if q.form == "ASK":
            return json.dumps({"head": {}, "boolean": self.engine.ask(q)})
        s = self.engine.solutions(q)
        boxed = s.df.select(*[box(Value(s.value(n).col, k)).alias(n) for n, k in s.kinds.items()])
        return json.dumps({"head": {"vars": list(s.kinds)}, "results": {"bindings": [{n: turtle.json_term(r[n]) for n in s.kinds if r[n] is not None} for r in boxed.collect()]}})


def substituted(q, bindings: dict[str, object]):
    """The query with variables replaced by terms wherever they stand, but for the names it gives to results."""
    from dataclasses import fields, is_dataclass, replace

    from quadloom.sparql.ast import Bind, Query

    if not bindings:
        return q

    def walk(x):
        if isinstance(x, Var):
            return bindings.get(x.name, x)
        if isinstance(x, (list, tuple)):
            return type(x)(walk(y) for y in x)
        if isinstance(x, Bind):
            return Bind(walk(x.expr), x.var)
        if is_dataclass(x) and not isinstance(x, type):
            return replace(x, **{f.name: walk(getattr(x, f.name)) for f in fields(x) if f.init})
        return x

    own = walk(q)
    names = q.projection if q.projection is not None else None
    if isinstance(own, Query) and names is not None:
        own.projection = [(n, walk(e) if e is not None else bindings[n] if n in bindings else None) for n, e in names]
    return own

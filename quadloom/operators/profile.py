"""What a graph is like: derived shapes, descriptions, and the triples that a query uses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.functions.terms import K_BNODE, K_IRI, K_LITERAL, number
from quadloom.operators.closure import closure
from quadloom.plans.engine import Engine
from quadloom.sparql.ast import RDF, Bgp, Filter, Graph, Group, Minus, Optional_, SubSelect, Triple, Union_, Var
from quadloom.sparql.parser import parse_query


def derive_shapes(quads: DataFrame) -> DataFrame:
    """For each class and predicate of its members: how many have it, the least and greatest number of values,
    kinds and datatypes found, and the range and lengths of the values."""
    types = quads.where(F.col("p") == RDF + "type").select("s", F.col("o")["v"].alias("class")).distinct()
    members = types.groupBy("class").agg(F.count("*").alias("members"))
    facts = quads.where(F.col("p") != RDF + "type").join(types, "s")
    o = F.col("o")
    each = facts.groupBy("class", "p", "s").agg(F.count("*").alias("n"), F.min(number(o)).alias("low"), F.max(number(o)).alias("high"), F.min(F.when(o["k"] == K_LITERAL, F.length(o["v"]))).alias("short"), F.max(F.when(o["k"] == K_LITERAL, F.length(o["v"]))).alias("long"))
    kinds = facts.groupBy("class", "p").agg(F.array_sort(F.collect_set(F.when(o["k"] == K_LITERAL, o["dt"]).when(o["k"] == K_IRI, "IRI").when(o["k"] == K_BNODE, "BlankNode").otherwise("TripleTerm"))).alias("kinds"))
    summed = each.groupBy("class", "p").agg(F.count("*").alias("have"), F.min("n").alias("least"), F.max("n").alias("most"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("short").alias("shortest"), F.max("long").alias("longest"))
    return summed.join(members, "class").join(kinds, ["class", "p"]).withColumn("least", F.when(F.col("have") < F.col("members"), 0).otherwise(F.col("least")))


def cbd(quads: DataFrame, resources: DataFrame) -> DataFrame:
    """Concise bounded descriptions of resources (s): their quads and those of the blank nodes they lead to."""
    blank = quads.where(F.col("o")["k"] == K_BNODE).select("s", "o")
    first = blank.join(resources.select("s").distinct(), "s", "left_semi").select(F.col("o").alias("s")).distinct()
    reach = closure(blank.where(F.col("s")["k"] == K_BNODE), first).select(F.col("o").alias("s"))
    nodes = resources.select("s").unionByName(first).unionByName(reach).distinct()
    return quads.join(nodes, "s", "left_semi").select("g", "s", "p", "o")


def _patterns(p, graph=None) -> list[tuple[object, Triple]]:
    """Simple triple patterns of a pattern, with their graphs."""
    if isinstance(p, Group):
        return [x for part in p.parts if not isinstance(part, Filter) for x in _patterns(part, graph)]
    if isinstance(p, Bgp):
        return [(graph, t) for t in p.triples]
    if isinstance(p, Union_):
        return [x for b in p.branches for x in _patterns(b, graph)]
    if isinstance(p, (Optional_, Minus)):
        return _patterns(p.pattern, graph)
    if isinstance(p, Graph):
        return _patterns(p.pattern, p.name)
    if isinstance(p, SubSelect):
        return _patterns(p.query.pattern, graph)
    return []


def relevant_subgraph(engine: Engine, text: str) -> DataFrame:
    """The quads that a query's solutions rest on: its patterns filled in with each solution, as far as they are in the graph.

    A pattern with a path keeps all triples of the predicates the path names, which may be more than needed.
    """
    q = parse_query(text, engine.prefixes)
    s = engine._pattern(q.pattern, None)
    patterns = _patterns(q.pattern)
    simple = [(g, t) for g, t in patterns if hasattr(t.p, "v") or isinstance(t.p, Var)]
    filled = engine.instantiate(s, simple)
    out = engine.graph.quads.join(filled, ["g", "s", "p", "o"], "left_semi")
    paths = {v for _, t in patterns if not (hasattr(t.p, "v") or isinstance(t.p, Var)) for v in _named(t.p)}
    if paths:
        out = out.unionByName(engine.graph.quads.where(F.col("p").isin(*sorted(paths)))).distinct()
    return out.select("g", "s", "p", "o")


def _named(path) -> set[str]:
    if hasattr(path, "v"):
        return {path.v}
    return set().union(*[_named(x) for x in (getattr(path, "a", None), getattr(path, "b", None)) if x is not None]) | set(getattr(path, "forward", ())) | set(getattr(path, "inverse", ()))



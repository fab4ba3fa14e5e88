"""SHACL inference rules: triple rules and SPARQL rules, by order and to a fixpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.functions.terms import K_BNODE, K_IRI
from quadloom.operators.node_expressions import values_of
from quadloom.operators.shacl import Shape, Shapes, Validator
from quadloom.plans.durable import durable
from quadloom.plans.engine import Engine
from quadloom.plans.solution import join, semi_join
from quadloom.sources.graphs import QuadGraph
from quadloom.sparql.ast import RDF, SH, XSD, IRI, Lit
from quadloom.sparql.parser import parse_query

COLUMNS = ["g", "s", "p", "o"]
TRUE = Lit("true", XSD + "boolean")


def apply_rules(graph: QuadGraph, shapes_text: str, prefixes: dict[str, str] | None = None, rounds: int = 1000) -> DataFrame:
    """The quads that the rules add; the graph is not changed.

    Layers (sh:layer) run one after the other. In a layer the rules marked sh:runOnce run once, by
    sh:order; then the others, those of one order together on base and derived triples until none is new,
    lower orders first. A pass of a rule runs once for all its focus nodes. Each round's new triples are
    a table.
    """
    shapes = Shapes(shapes_text, prefixes)
    rules: dict[tuple, list[tuple[Shape, object]]] = {}
    for node, facts in list(shapes.facts.items()):
        for rule in facts.get(SH + "rule", []):
            own = shapes.facts[rule]
            if TRUE not in own.get(SH + "deactivated", []):
                layer, order = (float(own.get(SH + n, [Lit("0")])[0].v) for n in ("layer", "order"))
                again = TRUE not in own.get(SH + "runOnce", [])
                rules.setdefault((layer, again, order), []).append((shapes.shape(node), rule))
    base = graph.quads.select(COLUMNS)
    made = durable(base.where("false"), "shacl-rules")
    for layer, again, order in sorted(rules):
        for nth in range(rounds):
            if nth and not again:
                break
            view = base.unionByName(made)
            validator = Validator(Engine(QuadGraph(view), prefixes), shapes)
            parts = [_run(validator, shape, rule) for shape, rule in rules[layer, again, order]]
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p)
            new = durable(out.distinct().join(view, COLUMNS, "left_anti").select(COLUMNS), "shacl-rules")
            if new.isEmpty():
                break
            made = made.unionByName(new)
        else:
            raise RuntimeError(f"no fixpoint after {rounds} rounds")
    return made


def _run(validator: Validator, shape: Shape, rule) -> DataFrame:
    facts = validator.shapes.facts[rule]
    focus = validator.targets(shape)
    for condition in facts.get(SH + "condition", []):
        focus = semi_join(focus, validator.failing(condition, focus), True)
    if SH + "construct" in facts:
        q = parse_query(facts[SH + "construct"][0].v, validator.engine.prefixes)
        s = validator.engine._pattern(q.pattern, None)
        named = focus.select({"this": focus.value("focus")}, {"this"})
        return validator.engine.instantiate(join(named, s) if s.kinds else named, [(None, t) for t in q.template])
    if IRI(SH + "TripleRule") not in facts.get(RDF + "type", []):
        raise NotImplementedError(f"a rule of type {facts.get(RDF + 'type')}")
    parts = [values_of(validator, facts[SH + name][0], focus).select("focus", F.col("node").alias(name)) for name in ("subject", "predicate", "object")]
    all_ = parts[0].join(parts[1], "focus").join(parts[2], "focus")
    valid = all_.where(F.col("subject")["k"].isin(K_IRI, K_BNODE) & (F.col("predicate")["k"] == K_IRI))
    return valid.select(F.lit("").alias("g"), F.col("subject").alias("s"), F.col("predicate")["v"].alias("p"), F.col("object").alias("o")).distinct()



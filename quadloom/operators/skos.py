"""Integrity conditions of SKOS, each as one query over the whole graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.functions.terms import box
from quadloom.plans.engine import Engine

PREFIX = "PREFIX skos: <http://www.w3.org/2004/02/skos/core#>\n"
_UP = "(skos:broader|skos:broaderTransitive|skos:broadMatch|^skos:narrower|^skos:narrowerTransitive|^skos:narrowMatch)"
#: Condition of the SKOS reference to the nodes that break it.
CONDITIONS = {
    "S9": "SELECT DISTINCT ?node { ?node a skos:ConceptScheme , skos:Concept }",
    "S13": "SELECT DISTINCT ?node { VALUES (?a ?b) { (skos:prefLabel skos:altLabel) (skos:prefLabel skos:hiddenLabel) (skos:altLabel skos:hiddenLabel) } ?node ?a ?label ; ?b ?label }",
    "S14": "SELECT DISTINCT ?node { ?node skos:prefLabel ?x , ?y FILTER(LANG(?x) = LANG(?y) && !sameTerm(?x, ?y)) }",
    "S27": f"SELECT DISTINCT ?node {{ ?node (skos:related|^skos:related) ?other . ?node {_UP}+ ?other }}",
    "S37": "SELECT DISTINCT ?node { ?node a skos:Collection . { ?node a skos:Concept } UNION { ?node a skos:ConceptScheme } }",
    "S46": "SELECT DISTINCT ?node { ?node (skos:exactMatch|^skos:exactMatch) ?other . { ?node (skos:broadMatch|^skos:broadMatch|skos:narrowMatch|^skos:narrowMatch) ?other } UNION { ?node (skos:relatedMatch|^skos:relatedMatch) ?other } }",
}


def check(engine: Engine, conditions: list[str] | None = None) -> DataFrame:
    """(condition, node) of the nodes that break a condition; all conditions, or those named."""
    out = None
    for name in conditions or CONDITIONS:
        s = engine.solutions(PREFIX + CONDITIONS[name])
        own = s.df.select(F.lit(name).alias("condition"), box(s.value("node")).alias("node"))
        out = own if out is None else out.unionByName(own)
    return out

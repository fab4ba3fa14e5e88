"""RDF and RDFS entailment by widening the patterns of a query; the data stay as they are."""

from __future__ import annotations

from quadloom.sparql.ast import RDF, RDFS, Bgp, Group, IRI, Mod, Seq, Triple, Union_, Var

TYPE, PROPERTY = IRI(RDF + "type"), IRI(RDF + "Property")
SUB_CLASS, SUB_PROPERTY = IRI(RDFS + "subClassOf"), IRI(RDFS + "subPropertyOf")


def widened(triples: list[Triple], regime: str) -> Group:
    """A pattern that finds on plain data what the triples find on the closure; one row for each derivation.

    RDF makes every predicate a property. RDFS follows the class and property hierarchies, domains and
    ranges. A variable predicate, which would need the whole closure, is refused: materialise it instead.
    """
    if regime not in ("RDF", "RDFS"):
        raise NotImplementedError(f"query-time entailment under {regime}; infer() makes the closure")
    return Group([_one(t, regime, i) for i, t in enumerate(triples)])


def _one(t: Triple, regime: str, i: int):
    own, by, other = Bgp([t]), Var(f"~by{i}"), Var(f"~with{i}")
    if not isinstance(t.p, IRI):
        if isinstance(t.p, Var):
            raise NotImplementedError("a variable predicate under query-time entailment; infer() makes the closure")
        return own
    if t.p == TYPE and t.o == PROPERTY:
        return Union_([Group([own]), Group([Bgp([Triple(Var(f"~from{i}"), t.s, other)])])]) if isinstance(t.s, Var) else own
    if regime == "RDF":
        return own
    if t.p in (SUB_CLASS, SUB_PROPERTY):
        return Bgp([Triple(t.s, Mod(t.p, "+"), t.o)])
    if t.p != TYPE:
        return Bgp([Triple(by, Mod(SUB_PROPERTY, "*"), t.p), Triple(t.s, by, t.o)])
    up = lambda first: Seq(Mod(SUB_PROPERTY, "*"), Seq(IRI(RDFS + first), Mod(SUB_CLASS, "*")))
    return Union_(
        [
            Group([Bgp([Triple(t.s, Seq(TYPE, Mod(SUB_CLASS, "*")), t.o)])]),
            Group([Bgp([Triple(by, up("domain"), t.o), Triple(t.s, by, other)])]),
            Group([Bgp([Triple(by, up("range"), t.o), Triple(other, by, t.s)])]),
        ]
    )

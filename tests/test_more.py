"""Documents, updates of absent graphs, checks of rules, and the shape of plans."""

import pytest

from quadloom.graph import RdfGraph
from quadloom.operators.rules import RuleSet
from quadloom.plans.engine import Engine, GraphError
from quadloom.sources.documents import DocumentError, parse_jsonld, parse_rdfxml
from quadloom.sources.graphs import QuadGraph
from quadloom.sparql.ast import RDF, BNode, IRI, Lit
from quadloom.sparql.parser import SyntaxProblem

P = {"": "http://e/"}
HEAD = f'<rdf:RDF xmlns:rdf="{RDF}" xmlns:e="http://e/" xml:base="http://b/d">'


def facts(quads):
    return {(t.s, t.p.v.replace("http://e/", "").replace(RDF, "rdf:"), t.o) for _, t in quads}


def test_rdfxml():
    a = IRI("http://b/a")
    got = facts(parse_rdfxml(HEAD + '<e:T rdf:about="a" e:p="q" xml:lang="en"><e:n>x</e:n><e:i rdf:datatype="http://e/dt">5</e:i><e:r rdf:resource="z"/><e:x rdf:nodeID="m"/></e:T></rdf:RDF>'))
    assert got == {(a, "rdf:type", IRI("http://e/T")), (a, "p", Lit("q", RDF + "langString", "en")), (a, "n", Lit("x", RDF + "langString", "en")), (a, "i", Lit("5", "http://e/dt")), (a, "r", IRI("http://b/z")), (a, "x", BNode("nm"))}
    lists = parse_rdfxml(HEAD + '<rdf:Description rdf:about="a"><e:c rdf:parseType="Collection"><rdf:Description rdf:about="1"/><rdf:Description rdf:about="2"/></e:c></rdf:Description></rdf:RDF>')
    assert len(lists) == 5 and sum(t.p.v == RDF + "first" for _, t in lists) == 2
    reified = parse_rdfxml(HEAD + '<rdf:Bag rdf:ID="bag"><rdf:li rdf:ID="one">a</rdf:li><rdf:li>b</rdf:li></rdf:Bag></rdf:RDF>')
    assert {t.p.v.removeprefix(RDF) for _, t in reified} == {"type", "_1", "_2", "subject", "predicate", "object"}
    with pytest.raises(DocumentError):
        parse_rdfxml(HEAD + '<rdf:Bag rdf:ID="x"/><rdf:Bag rdf:ID="x"/></rdf:RDF>')


def test_jsonld():
    text = '{"@context": ["http://c/x", {"n": "e:n", "k": {"@id": "e:k", "@type": "@id"}, "back": {"@reverse": "e:of"}}], "@graph": [{"@id": "a", "n": ["x", 2.5], "k": "z", "back": {"@id": "q"}}, {"@id": "http://b/g", "@graph": [{"@id": "http://b/s", "e:p": {"@list": [true]}}]}]}'
    got = parse_jsonld(text, "http://b/", {"http://c/x": '{"@context": {"e": "http://e/"}}'}.get)
    assert facts(q for q in got if q[0] is None) == {(IRI("http://b/a"), "n", Lit("x")), (IRI("http://b/a"), "n", Lit("2.5E0", "http://www.w3.org/2001/XMLSchema#double")), (IRI("http://b/a"), "k", IRI("http://b/z")), (IRI("http://b/q"), "of", IRI("http://b/a"))}
    assert {g for g, _ in got if g is not None} == {IRI("http://b/g")} and len(got) == 7
    with pytest.raises(DocumentError):
        parse_jsonld('{"@context": "http://c/x"}')


def test_updates_of_graphs_that_are_or_are_not_there(spark):
    g = RdfGraph(spark, prefixes=P).parse(data=":g { :a :p 1 }", format="trig")
    for text in ("DROP GRAPH :none", "CLEAR GRAPH :none", "CREATE GRAPH :g", "COPY :none TO :x", "MOVE :none TO :x"):
        with pytest.raises(GraphError):
            g.update(text)
        assert len(g.update(text.replace("GRAPH", "SILENT GRAPH").replace("COPY", "COPY SILENT").replace("MOVE", "MOVE SILENT"))) in (0, 1)
    assert len(g.update("CREATE GRAPH :new ; DROP GRAPH :g")) == 0


@pytest.mark.parametrize("rule", ["RULE { ?a :q ?z } WHERE { ?a :p ?o }", "RULE { ?a :q 1 } WHERE { ?a :p ?o FILTER(?z > 1) }", "RULE { ?a :q 1 } WHERE { ?a :p ?o SET(?o := 1) }", "RULE { ?a :q ?n } WHERE { GROUP BY ?z { ?a :p ?o } [ ?n := COUNT(*) ] }", "RULE { ?a :q 1 } WHERE { ?a :p ?o NOT { ?a :q 1 } }", "IMPORTS <http://e/x>"])
def test_rules_that_are_refused(rule):
    with pytest.raises(SyntaxProblem):
        RuleSet(rule, P).strata()


def test_compatible_joins_have_no_product_where_both_sides_bind(spark):
    g = RdfGraph(spark, prefixes=P).parse(data=":a :p 1 . :b :p 2 . :c :q 1 .", format="turtle")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = Engine(QuadGraph(g.quads), P).select("SELECT ?x ?y ?n { { ?x :p ?m OPTIONAL { ?x :p ?n FILTER(?n > 1) } } { ?y :q ?m2 OPTIONAL { ?y :q ?n } } }", lexical_forms=True)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "OR" not in [w for line in plan.splitlines() if "Join" in line for w in line.split()]
        assert {tuple(r) for r in df.collect()} == {("http://e/a", "http://e/c", "1")}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

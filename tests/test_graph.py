"""The graph as a value, its formats, and what is derived from it."""

import json

import pytest

from quadloom.graph import NotUnique, RdfGraph
from quadloom.operators import profile, setops
from quadloom.sparql.ast import XSD, IRI, Lit, Triple

P = {"": "http://e/", "xsd": XSD}
TEXT = ':a a :T ; :p 1 , 2 ; :q "x\\ny"@en ; :r [ :s [ :t 1.5 ] ] . :b a :T ; :p 5 ; :when "2024-01-01"^^xsd:date .'


@pytest.fixture(scope="module")
def graph(spark):
    return RdfGraph(spark, None, P).parse(data=TEXT)


def e(name):
    return IRI("http://e/" + name)


def test_patterns(graph):
    assert len(graph) == 10 and Triple(e("a"), e("p"), Lit("1", XSD + "integer")) in graph and Triple(e("a"), e("p"), Lit("1")) not in graph
    assert graph.subjects(e("p")).count() == 2 and graph.objects(e("a"), e("p")).count() == 2 and graph.predicates(e("b")).count() == 3
    assert graph.value(e("b"), e("p")).v == "5" and graph.value(e("b"), e("none"), default=0) == 0
    with pytest.raises(NotUnique):
        graph.value(e("a"), e("p"), any=False)


def test_changes_and_sets(graph):
    more = graph.add(Triple(e("c"), e("p"), Lit("7", XSD + "integer")), graph="http://e/g")
    assert more.graph_names() == ["http://e/g"] and len(more) == 11 and len(graph) == 10 and len(more.graph("http://e/g")) == 1
    assert len(more.remove(None, e("p"))) == 7 and len(more.remove_graph("http://e/g")) == 10 and not graph.has_graph("http://e/g")
    assert len(graph & more) == 10 and len(more - graph) == 1 and len(graph ^ more) == 1 and len(graph + more) == 11
    assert more.update("INSERT DATA { GRAPH :g { :a :p 1 } }").overlap().count() == 1 and len(more.merged()) == 11


def test_turtle_round_trip(graph, spark):
    text = graph.serialize(format="turtle")
    again = RdfGraph(spark).parse(data=text)
    ground = "s.k <> 1 and o.k <> 1"
    assert len(again) == len(graph) and setops.same_ground(again.quads.where(ground), graph.quads.where(ground))
    named = graph.add(Triple(e("c"), e("p"), e("a")), graph="http://e/g")
    with pytest.raises(ValueError):
        named.serialize(format="turtle")
    assert len(RdfGraph(spark).parse(data=named.serialize(format="trig"), format="trig")) == 11
    assert RdfGraph.format_of("x/y.trig") == "trig"


def test_files(graph, spark, tmp_path):
    graph.serialize(str(tmp_path / "x.ttl"), "turtle")
    assert len(RdfGraph(spark).parse(str(tmp_path / "x.ttl"))) == 10
    (tmp_path / "x.nt").write_text(graph.serialize(format="nt"))
    assert len(RdfGraph(spark).parse(str(tmp_path / "x.nt"), graph="http://e/h").graph("http://e/h")) == 10


def test_queries(graph):
    assert graph.query("ASK { :a :p 2 }") and len(graph.query("CONSTRUCT { ?s :n ?o } WHERE { ?s :p ?o }")) == 3
    got = graph.query("SELECT ?s ?o WHERE { ?s :p ?o { ?s a ?t } }", {"s": e("b")}).collect()
    assert [(r.s, r.o.v) for r in got] == [("http://e/b", "5")]
    told = json.loads(graph.results_json("SELECT ?q ?w WHERE { :a :q ?q OPTIONAL { :a :none ?w } }"))
    assert told == {"head": {"vars": ["q", "w"]}, "results": {"bindings": [{"q": {"type": "literal", "value": "x\ny", "xml:lang": "en"}}]}}


def test_profile(graph, spark):
    shapes = {r.p.rpartition("/")[2]: r for r in profile.derive_shapes(graph.quads).collect()}
    assert (shapes["p"].members, shapes["p"].have, shapes["p"].least, shapes["p"].most, shapes["p"].low, shapes["p"].high) == (2, 2, 1, 2, 1.0, 5.0)
    assert shapes["q"].least == 0 and shapes["r"].kinds == ["BlankNode"]
    assert profile.cbd(graph.quads, graph.quads.where("s.v = 'http://e/a'").select("s")).count() == 7
    used = profile.relevant_subgraph(graph.engine, "SELECT * WHERE { ?s :p ?n FILTER(?n > 1) OPTIONAL { ?s :q ?t } }")
    assert sorted((r.p.rpartition("/")[2], r.o.v) for r in used.collect()) == [("p", "2"), ("p", "5"), ("q", "x\ny")]


def test_basic_encoding(spark):
    text = ":r rdf:reifies <<( :a :p <<( :b :q 1 )>> )>> . :s rdf:reifies <<( :b :q 1 )>> . :s :x 2 ."
    g = RdfGraph(spark, None, P | {"rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#"}).parse(data=text)
    told = setops.to_basic(g.quads)
    assert told.where("o.k = 4").isEmpty() and told.count() == 11
    assert setops.same_ground(setops.from_basic(told), g.quads)
    with pytest.raises(ValueError):
        setops.from_basic(told.where("p not like '%Object'"))


def test_isomorphism(spark):
    one = RdfGraph(spark, None, P).parse(data="_:a :p _:b . _:b :p 1 ; :q _:c . _:c :p 2 .").quads
    two = RdfGraph(spark, None, P).parse(data="_:x :p 2 . _:y :p 1 ; :q _:x . _:z :p _:y .").quads
    other = RdfGraph(spark, None, P).parse(data="_:x :p 2 . _:y :p 1 ; :q _:x . _:z :p _:x .").quads
    assert setops.isomorphic(one, two) and not setops.isomorphic(one, other)
    assert setops.digest(setops.canonical(one)) == setops.digest(setops.canonical(two))
    with pytest.raises(ValueError):
        setops.canonical(RdfGraph(spark, None, P).parse(data="_:a :p _:b . _:b :p _:a .").quads)


def test_query_time_entailment(spark):
    from quadloom.plans.engine import Engine
    from quadloom.sources.graphs import QuadGraph

    p = P | {"rdfs": "http://www.w3.org/2000/01/rdf-schema#", "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#"}
    g = RdfGraph(spark, None, p).parse(data=":A rdfs:subClassOf :B . :B rdfs:subClassOf :C . :x a :A . :part rdfs:subPropertyOf :of ; rdfs:domain :D . :of rdfs:range :E . :y :part :z .")
    e = Engine(QuadGraph(g.quads), p, entailment="RDFS")
    names = lambda q: sorted(str(r[0].v if hasattr(r[0], "v") else r[0])[-1] for r in e.select(q).collect())
    assert names("SELECT ?s { ?s a :C }") == ["x"] and names("SELECT ?s { ?s a :D }") == ["y"] and names("SELECT ?s { ?s a :E }") == ["z"]
    assert names("SELECT ?o { :y :of ?o }") == ["z"] and names("SELECT ?c { :A rdfs:subClassOf ?c }") == ["B", "C"]
    with pytest.raises(NotImplementedError):
        e.select("SELECT ?p { :x ?p ?o }")

"""Node expressions, rules, and the constraints on lists and reifiers."""

import pytest

from quadloom.operators import shacl
from quadloom.operators.node_expressions import values_of
from quadloom.operators.shacl_rules import apply_rules
from quadloom.plans.engine import Engine
from quadloom.sources.graphs import QuadGraph
from quadloom.sparql.ast import IRI
from quadloom.sparql.parser import parse_turtle

P = {"": "http://e/", "xsd": "http://www.w3.org/2001/XMLSchema#", "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "sh": "http://www.w3.org/ns/shacl#", "x": "http://www.w3.org/ns/shacl-node-expr#"}

DATA = """
:a a :N ; :p 3 , 1 , 2 ; :knows :b , :c ; :l (1 2 2) ; :age 5 .
:b a :N ; :p 9 ; :l (1 "x") ; :age 7 {| :source :web |} .
:c a :N ; :l () .
:d a :N ; :l :b .
"""


@pytest.fixture(scope="module")
def engine(spark):
    graph = QuadGraph.of(spark, parse_turtle(DATA, P))
    return Engine(QuadGraph(spark.createDataFrame(graph.quads.collect(), graph.quads.schema)), P)


EXPRESSIONS = [
    ("[ x:pathValues :p ]", "a", ["1", "2", "3"]),
    ("[ x:count [ x:pathValues :p ] ]", "c", ["0"]),
    ("[ x:sum [ x:pathValues :p ] ]", "a", ["6"]),
    ("[ x:max [ x:pathValues :p ] ]", "a", ["3"]),
    ("[ x:min [ x:pathValues :p ] ]", "c", []),
    ("[ x:exists [ x:pathValues :p ] ]", "c", ["false"]),
    ("[ x:if [ x:exists [ x:pathValues :p ] ] ; x:then 'yes' ; x:else 'no' ]", "c", ["no"]),
    ("[ x:concat ( [ x:pathValues :p ] 7 7 ) ]", "b", ["9", "7", "7"]),
    ("[ x:distinct [ x:concat ( 7 8 7 ) ] ]", "b", ["7", "8"]),
    ("[ x:intersection ( [ x:pathValues :p ] [ x:concat ( 2 3 4 ) ] ) ]", "a", ["2", "3"]),
    ("[ x:remove 2 ; x:nodes [ x:pathValues :p ] ]", "a", ["1", "3"]),
    ("[ x:limit 2 ; x:nodes [ x:pathValues :p ] ]", "a", ["1", "2"]),
    ("[ x:offset 1 ; x:nodes [ x:pathValues :p ] ]", "a", ["2", "3"]),
    ("[ x:orderBy sh:this ; x:desc true ; x:nodes [ x:pathValues :p ] ]", "a", ["3", "2", "1"]),
    ("[ x:flatMap [ x:pathValues :p ] ; x:nodes [ x:pathValues :knows ] ]", "a", ["9"]),
    ("[ x:filterShape [ sh:minInclusive 2 ] ; x:nodes [ x:pathValues :p ] ]", "a", ["2", "3"]),
    ("[ x:findFirst [ sh:minInclusive 2 ] ; x:nodes [ x:pathValues :p ] ]", "a", ["2"]),
    ("[ x:matchAll [ sh:minInclusive 2 ] ; x:nodes [ x:pathValues :p ] ]", "b", ["true"]),
    ("[ x:count [ x:instancesOf :N ] ]", "b", ["4"]),
    ("[ x:var 'focusNode' ]", "b", ["http://e/b"]),
]


@pytest.mark.parametrize("text,focus,want", EXPRESSIONS, ids=range(len(EXPRESSIONS)))
def test_expressions(engine, text, focus, want):
    v = shacl.Validator(engine, shacl.Shapes(f":holder :is {text} .", P))
    expr = v.shapes.facts[IRI("http://e/holder")]["http://e/is"][0]
    got = values_of(v, expr, v.instances(IRI("http://e/N"))).where(f"focus.v = 'http://e/{focus}'").orderBy("pos").collect()
    assert [r.node.v for r in got] == want


def found(engine, shapes):
    return sorted((r.focus.strip("<>").removeprefix("http://e/"), r.component.split("#")[1].removesuffix("ConstraintComponent")) for r in shacl.validate(engine, shapes).collect())


def test_lists(engine):
    shapes = ":S a sh:NodeShape ; sh:targetClass :N ; sh:property [ sh:path :l ; sh:minListLength 1 ; sh:maxListLength 2 ; sh:uniqueMembers true ; sh:memberShape [ sh:datatype xsd:integer ] ] ."
    every = [("d", n) for n in ("MinListLength", "MaxListLength", "UniqueMembers", "MemberShape")]
    assert found(engine, shapes) == sorted([*every, ("a", "MaxListLength"), ("a", "UniqueMembers"), ("b", "MemberShape"), ("c", "MinListLength")])


def test_reifiers_some_value_and_expression(engine):
    shapes = """:S a sh:NodeShape ; sh:targetClass :N ;
      sh:property [ sh:path :age ; sh:reificationRequired true ; sh:reifierShape [ sh:property [ sh:path :date ; sh:minCount 1 ] ] ] ;
      sh:property [ sh:path :p ; sh:someValue [ sh:maxInclusive 1 ] ] ;
      sh:expression [ x:exists [ x:pathValues :p ] ] ."""
    assert found(engine, shapes) == sorted([("a", "ReificationRequired"), ("b", "ReifierShape"), ("b", "SomeValue"), ("c", "SomeValue"), ("d", "SomeValue"), ("c", "Expression"), ("d", "Expression")])


def test_rules(spark):
    graph = QuadGraph.of(spark, parse_turtle(":a :reach :b . :b :reach :c . :c :reach :d . :r a :Box ; :w 2 ; :h 3 . :q a :Box ; :w 0 .", P))
    shapes = """
    :Reach a sh:NodeShape ; sh:targetSubjectsOf :reach ; sh:rule [ a sh:SPARQLRule ; sh:construct "CONSTRUCT { $this :reach ?z } WHERE { $this :reach ?y . ?y :reach ?z FILTER($this != ?z) }" ] .
    :B a sh:NodeShape ; sh:targetClass :Box ;
      sh:rule [ a sh:TripleRule ; sh:subject sh:this ; sh:predicate :size ; sh:object [ x:sum [ x:concat ( [ x:pathValues :w ] [ x:pathValues :h ] ) ] ] ; sh:condition [ sh:property [ sh:path :w ; sh:minExclusive 0 ] ] ] ;
      sh:rule [ a sh:TripleRule ; sh:order 1 ; sh:subject sh:this ; sh:predicate :sized ; sh:object [ x:exists [ x:pathValues :size ] ] ] .
    """
    got = sorted((r.s.v[9:], r.p[9:], r.o.v.removeprefix("http://e/")) for r in apply_rules(graph, shapes, P).collect())
    assert got == [("a", "reach", "c"), ("a", "reach", "d"), ("b", "reach", "d"), ("q", "sized", "false"), ("r", "size", "5"), ("r", "sized", "true")]


MORE = """
:x a :P ; :friend :y ; :age 3 ; :n 1 . :y a :P ; :friend :x ; :age 4 . :z a :P ; :friend :w ; :age 5 . :w :friend :z .
:v sh:shape :Linked ; :age 30 . :q :part :h1 , :h2 ; a :Q . :h1 :left 1 ; :right 1 . :h2 :left 2 .
"""
SHAPES = {
    "recursive": (":S a sh:NodeShape ; sh:targetClass :P ; sh:property [ sh:path :friend ; sh:node :S ] ; sh:property [ sh:path :age ; sh:minCount 1 ] .", [("z", "Node")]),
    "linked": (":Linked a sh:NodeShape ; sh:property [ sh:path :age ; sh:maxInclusive 9 ] .", [("v", "MaxInclusive")]),
    "where": (":S sh:targetWhere [ sh:property [ sh:path :age ; sh:minCount 1 ; sh:maxInclusive 9 ] ] ; sh:property [ sh:path :friend ; sh:hasValue :x ] .", [("x", "HasValue"), ("z", "HasValue")]),
    "disjoint": (":S sh:targetClass :Q ; sh:property [ sh:path :part ; sh:qualifiedMinCount 1 ; sh:qualifiedValueShapesDisjoint true ; sh:qualifiedValueShape [ sh:property [ sh:path :right ; sh:minCount 1 ] ] ] , [ sh:path :part ; sh:qualifiedMinCount 1 ; sh:qualifiedValueShape [ sh:property [ sh:path :left ; sh:minCount 1 ] ] ] .", [("q", "QualifiedMinCount")]),
    "types": (":S sh:targetClass :P ; sh:closed sh:ByTypes ; sh:property [ sh:path :age ] , [ sh:path :friend ] .", [("x", "Closed")]),
    "sparql": (":S sh:targetClass :P ; sh:property [ sh:path :age ; sh:sparql [ sh:select 'SELECT $this ?value WHERE { $this $PATH ?value FILTER(?value > 4) }' ] ] .", [("z", "SPARQL")]),
    "ask": (":C sh:parameter [ sh:path :below ] ; sh:validator [ sh:ask 'ASK { FILTER($value < $below) }' ] . :S sh:targetClass :P ; sh:property [ sh:path :age ; :below 5 ] .", [("z", "http://e/C")]),
    "select": (":C sh:parameter [ sh:path :least ] ; sh:propertyValidator [ sh:select 'SELECT $this ?value WHERE { $this $PATH ?value FILTER(?value < $least) }' ] . :S sh:targetClass :P ; sh:property [ sh:path :age ; :least 4 ] .", [("x", "http://e/C")]),
    "values": (":S sh:targetClass :P ; sh:property [ sh:path :n ; sh:defaultValue 7 ; sh:maxInclusive 6 ] .", [("y", "MaxInclusive"), ("z", "MaxInclusive")]),
}


@pytest.fixture(scope="module")
def more(spark):
    graph = QuadGraph.of(spark, parse_turtle(MORE, P))
    return Engine(QuadGraph(spark.createDataFrame(graph.quads.collect(), graph.quads.schema)), P)


@pytest.mark.parametrize("name", SHAPES)
def test_further_constraints(more, name):
    text, want = SHAPES[name]
    got = sorted((r.focus.removeprefix("<http://e/").rstrip(">"), r.component.removeprefix("http://www.w3.org/ns/shacl#").removesuffix("ConstraintComponent")) for r in shacl.validate(more, text, P).collect())
    assert got == want


def test_recursion_through_negation_is_refused(more):
    with pytest.raises(ValueError, match="negation"):
        shacl.validate(more, ":S sh:targetClass :P ; sh:not [ sh:property [ sh:path :friend ; sh:node :S ] ] .", P)


def test_report(more):
    text = ":S sh:targetClass :P ; sh:severity sh:Warning ; sh:property [ sh:path ( :friend [ sh:inversePath :friend ] ) ; sh:message 'no' ; sh:maxCount 0 ; sh:severity sh:Warning ] ."
    view = Engine(QuadGraph(shacl.report_graph(more, text)), P)
    assert view.ask("ASK { ?r a sh:ValidationReport ; sh:conforms false ; sh:result [ sh:focusNode :x ; sh:resultMessage 'no' ; sh:resultPath/rdf:rest/rdf:first/sh:inversePath :friend ; sh:resultSeverity sh:Warning ] }")
    view = Engine(QuadGraph(shacl.report_graph(more, text, disallows=("http://www.w3.org/ns/shacl#Violation",))), P)
    assert view.ask("ASK { ?r sh:conforms true }")


def test_report_joins_nothing_by_few_keys(more):
    """Paths and messages of a report are few: a join by them would bring its results together in few tasks."""
    text = ":S sh:targetClass :P ; sh:property [ sh:path :friend ; sh:message 'no' , 'nein'@de , 'no' ; sh:maxCount 0 ] , [ sh:path :n ; sh:minCount 1 ] ."
    report = shacl.report_graph(more, text)
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    assert report.count() == report.distinct().count()
    told = Engine(QuadGraph(report), P).select("SELECT ?p ?m { ?r sh:resultPath ?p OPTIONAL { ?r sh:resultMessage ?m } }", lexical_forms=True)
    assert {tuple(r) for r in told.collect()} == {("http://e/friend", "no"), ("http://e/friend", "nein"), ("http://e/n", None)}


def test_each_and_evaluate(more, engine):
    found = shacl.validate_each({"one": more, "two": engine}, ":S sh:targetSubjectsOf :age ; sh:property [ sh:path :age ; sh:maxInclusive 6 ] .", P).collect()
    assert sorted((r.data, r.focus) for r in found) == [("one", "<http://e/v>"), ("two", "<http://e/b>")]
    rows = shacl.evaluate(more, ":S sh:targetClass :P ; sh:property [ sh:path :n ; sh:defaultValue 7 ] .", IRI("http://e/S"), P).collect()
    assert sorted((r.focus.v[-1], r.value.v) for r in rows) == [("x", "1"), ("y", "7"), ("z", "7")]


def test_single_values_of_a_mapped_class_are_one_scan(spark, data):
    """Texts that violate are told apart by digests: nothing joins them to their nodes, and a count of them moves none."""
    from quadloom.queries import engine as mapped

    text = "t:D sh:targetClass t:Document ; sh:property [ sh:path t:documents_text ; sh:languageIn ( 'fr' ) ; sh:singleLine true ] ."
    found = shacl.validate(mapped(spark, data), text)
    plan = found.groupBy("component").count()._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "max(" not in plan
    rows = found.collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").where("text is not null").collect()}
    assert len(rows) == len(set(rows)) > 0
    assert {r.focus for r in rows if "SingleLine" in r.component} == {f"<https://example.org/t/document/{k}>" for k, v in texts.items() if "\n" in v or "\r" in v}
    assert all('"' in r.value for r in rows)


def test_a_shape_that_is_reached_twice_reports_once(more):
    text = ":S sh:targetClass :P ; sh:property :N . :Q sh:targetSubjectsOf :n ; sh:property :N . :N sh:path :n ; sh:pattern '^9' , '^8' ; sh:maxInclusive 0 ; sh:class :A , :B ."
    rows = [tuple(r) for r in shacl.validate(more, text, P).collect()]
    assert len(rows) == len(set(rows)) == 3 and {r[3].split("#")[1] for r in rows} == {"PatternConstraintComponent", "MaxInclusiveConstraintComponent", "ClassConstraintComponent"}

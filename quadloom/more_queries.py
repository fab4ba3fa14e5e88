"""Further registered queries: one for each operator or group of functions that the first ones leave out."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.graph import RdfGraph
from quadloom.operators import entailment, reification, setops, shacl, skos
from quadloom.operators.node_expressions import values_of
from quadloom.operators.rules import RuleSet
from quadloom.operators.shacl_rules import apply_rules
from quadloom.plans.catalog import PREFIXES, T
from quadloom.plans.durable import durable
from quadloom.plans.engine import Engine
from quadloom.queries import QUERIES, Registered, _sparql, _terms, engine, iri, quads_of
from quadloom.sources import names, ntriples
from quadloom.sources.graphs import QuadGraph
from quadloom.sources.store import Store
from quadloom.sparql.ast import IRI, Triple, TripleTerm, Var

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
NATION, REGION, PART, ORDER, CUSTOMER = (iri(n, k) for n, k in (("nation", "n_nationkey"), ("region", "n_regionkey"), ("part", "p_partkey"), ("order", "o_orderkey"), ("customer", "c_custkey")))
#: A zoned time of each order, made of its day.
ZONED = "BIND(STRDT(CONCAT(SUBSTR(STR(?d), 1, 10), 'T10:20:30.5+05:30'), xsd:dateTime) AS ?z)"

QUERIES |= {
    # forms and clauses
    "select_reduced": _sparql("SELECT REDUCED ?b { ?p t:p_brand ?b }", "SELECT p_brand AS b FROM part"),
    "trailing_values": _sparql("SELECT ?k ?n { ?k t:n_name ?n } VALUES ?n { 'NATION_3' 'NATION_4' 'none' }", f"SELECT {NATION} AS k, n_name AS n FROM nation WHERE n_name IN ('NATION_3', 'NATION_4')"),
    "prefix_and_base": _sparql("BASE <https://example.org/t/> PREFIX q: <https://example.org/t/> SELECT ?n { <nation/3> q:n_name ?n }", "SELECT n_name AS n FROM nation WHERE n_nationkey = 3"),
    "from_default": _sparql("SELECT ?o FROM <https://example.org/t/status/P> FROM <https://example.org/t/status/F> { ?o t:o_orderpriority '1-URGENT' }", f"SELECT {ORDER} AS o FROM orders WHERE o_orderstatus IN ('P', 'F') AND o_orderpriority = '1-URGENT'"),
    "from_named": _sparql("SELECT ?g (COUNT(*) AS ?n) FROM NAMED <https://example.org/t/status/P> { GRAPH ?g { ?o t:o_totalprice ?p } } GROUP BY ?g", f"SELECT {iri('status', 'o_orderstatus')} AS g, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1"),
    "product": _sparql("SELECT ?a ?b { ?r t:r_name ?a . ?s t:r_name ?b FILTER(?a < ?b) }", "SELECT a.r_name AS a, b.r_name AS b FROM region a, region b WHERE a.r_name < b.r_name"),
    "compatible_join": _sparql(
        "SELECT ?k ?g ?label { { ?k t:n_name ?n OPTIONAL { ?k t:n_regionkey ?g FILTER(?g = <https://example.org/t/region/1>) } } { VALUES (?g ?label) { (<https://example.org/t/region/1> 'one') (<https://example.org/t/region/2> 'two') (UNDEF 'any') } } }",
        f"""WITH n AS (SELECT {NATION} AS k, CASE WHEN n_regionkey = 1 THEN {REGION} END AS g FROM nation), v AS (SELECT * FROM (VALUES ('{T}region/1', 'one'), ('{T}region/2', 'two'), (NULL, 'any')) x(h, label))
        SELECT k, coalesce(g, h) AS g, label FROM n JOIN v ON g IS NULL OR h IS NULL OR g = h""",
    ),
    "compatible_optional": _sparql(
        "SELECT ?k ?g ?label { { ?k t:n_name ?n OPTIONAL { ?k t:n_regionkey ?g FILTER(?g != <https://example.org/t/region/0>) } } OPTIONAL { VALUES (?g ?label) { (<https://example.org/t/region/1> 'one') (<https://example.org/t/region/2> 'two') } } }",
        f"""WITH n AS (SELECT {NATION} AS k, CASE WHEN n_regionkey <> 0 THEN {REGION} END AS g FROM nation), v AS (SELECT * FROM (VALUES ('{T}region/1', 'one'), ('{T}region/2', 'two')) x(h, label))
        SELECT k, coalesce(g, h) AS g, label FROM n LEFT JOIN v ON g IS NULL OR g = h""",
    ),
    "compatible_minus": _sparql(
        "SELECT ?k ?g { { ?k t:n_name ?n OPTIONAL { ?k t:n_regionkey ?g FILTER(?g != <https://example.org/t/region/0>) } } MINUS { VALUES ?g { <https://example.org/t/region/1> UNDEF } } }",
        f"SELECT {NATION} AS k, CASE WHEN n_regionkey <> 0 THEN {REGION} END AS g FROM nation WHERE n_regionkey <> 1",
    ),
    "exists_in_bind": _sparql(
        "SELECT ?c ?rich (NOT EXISTS { ?o t:o_custkey ?c ; t:o_orderstatus 'P' } AS ?none) { ?c t:c_acctbal ?b BIND(IF(EXISTS { ?o t:o_custkey ?c ; t:o_totalprice ?p FILTER(?p > 400000) }, 'yes', 'no') AS ?rich) }",
        f"""SELECT {CUSTOMER} AS c, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) THEN 'yes' ELSE 'no' END AS rich,
        NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS "none" FROM customer""",
    ),
    "exists_in_order": _sparql(
        "SELECT ?k { ?k t:n_regionkey ?g } ORDER BY DESC(EXISTS { ?k t:n_name 'NATION_7' }) ?k LIMIT 1",
        f"SELECT {NATION} AS k FROM nation WHERE n_name = 'NATION_7'",
    ),
    "path_zero": _sparql("SELECT ?x { <https://example.org/t/nation/3> t:nothing* ?x }", f"SELECT '{T}nation/3' AS x"),
    "path_optional": _sparql("SELECT ?x { <https://example.org/t/nation/3> t:n_regionkey? ?x }", f"SELECT '{T}nation/3' AS x UNION ALL SELECT {REGION} FROM nation WHERE n_nationkey = 3"),
    "order_of_terms": _sparql("SELECT ?o { ?s ?p ?o . ?s a t:Region } ORDER BY ?o LIMIT 7", f"SELECT '{T}Region' AS o FROM region UNION ALL (SELECT r_name FROM region ORDER BY 1 LIMIT 2)"),
    # terms
    "bound_filter": _sparql("SELECT ?d { ?d t:documents_n_chars ?n OPTIONAL { ?d t:labels_quality ?q } FILTER(!BOUND(?q)) }", f"SELECT {iri('document', 'd.doc_id')} AS d FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NULL"),
    "fn_term_tests": _sparql(
        "SELECT ?i ?u ?l ?n ?b ?t (COUNT(*) AS ?c) { ?p a t:Part . ?p ?q ?o BIND(isIRI(?o) AS ?i) BIND(isURI(?o) AS ?u) BIND(isLITERAL(?o) AS ?l) BIND(isNUMERIC(?o) AS ?n) BIND(isBLANK(?o) AS ?b) BIND(isTRIPLE(?o) AS ?t) } GROUP BY ?i ?u ?l ?n ?b ?t",
        "SELECT i, i AS u, NOT i AS l, n, false AS b, false AS t, count(*) AS c FROM (SELECT unnest([true, false, false, false, false, false]) AS i, unnest([false, false, false, false, true, true]) AS n FROM part) GROUP BY ALL",
    ),
    "fn_languages": _sparql(
        "SELECT ?k ?a ?b ?c ?d ?e ?f ?g { ?k t:n_name ?n BIND(STRLANG(?n, 'en') AS ?x) BIND(STRLANGDIR(?n, 'he', 'rtl') AS ?y) BIND(LANG(?x) AS ?a) BIND(LANGDIR(?y) AS ?b) BIND(hasLANG(?x) AS ?c) BIND(hasLANGDIR(?x) AS ?d) BIND(hasLANGDIR(?y) AS ?e) BIND(LANGMATCHES(LANG(?y), 'HE') AS ?f) BIND(STR(DATATYPE(?y)) AS ?g) }",
        f"SELECT {NATION} AS k, 'en' AS a, 'rtl' AS b, true AS c, false AS d, true AS e, true AS f, '{RDF}dirLangString' AS g FROM nation",
    ),
    "fn_language_range": _sparql("SELECT ?d { ?d t:documents_text ?t FILTER(LANGMATCHES(LANG(?t), 'FR')) }", f"SELECT {iri('document', 'doc_id')} AS d FROM documents WHERE lang = 'fr'"),
    "fn_typed": _sparql(
        "SELECT ?p ?v ?t ?e ?s { ?p t:p_size ?z BIND(STRDT(CONCAT('0', STR(?z)), xsd:integer) AS ?x) BIND(STR(?x) AS ?v) BIND(STR(DATATYPE(?x)) AS ?t) BIND(?x = ?z AS ?e) BIND(sameTerm(?x, ?z) AS ?s) }",
        f"SELECT {PART} AS p, concat('0', p_size) AS v, '{XSD}integer' AS t, true AS e, false AS s FROM part",
    ),
    "fn_make_terms": _sparql(
        "SELECT ?k ?i ?u ?b ?same ?other { ?k t:n_name ?n BIND(STR(IRI(CONCAT('https://example.org/x/', ?n))) AS ?i) BIND(STR(URI(CONCAT('https://example.org/y/', ?n))) AS ?u) BIND(isBLANK(BNODE(?n)) AS ?b) BIND(BNODE(?n) = BNODE(?n) AS ?same) BIND(sameTerm(BNODE(), BNODE()) AS ?other) }",
        f"SELECT {NATION} AS k, concat('https://example.org/x/', n_name) AS i, concat('https://example.org/y/', n_name) AS u, true AS b, true AS same, false AS other FROM nation",
    ),
    "fn_fresh": _sparql(
        "SELECT ?k ?a ?b ?c ?d ?y { ?k t:n_name ?n BIND(STRLEN(STRUUID()) AS ?a) BIND(STRSTARTS(STR(UUID()), 'urn:uuid:') AS ?b) BIND(RAND() < 1 AS ?c) BIND(NOW() = NOW() AS ?d) BIND(YEAR(NOW()) AS ?y) }",
        f"SELECT {NATION} AS k, CAST(36 AS BIGINT) AS a, true AS b, true AS c, true AS d, CAST(2024 AS BIGINT) AS y FROM nation",
    ),
    "fn_triples": _sparql(
        "SELECT ?k ?t ?s ?p ?o ?e { ?k t:n_name ?n BIND(TRIPLE(?k, t:n_name, ?n) AS ?x) BIND(isTRIPLE(?x) AS ?t) BIND(STR(SUBJECT(?x)) AS ?s) BIND(STR(PREDICATE(?x)) AS ?p) BIND(STR(OBJECT(?x)) AS ?o) BIND(sameTerm(?x, <<( ?k t:n_name ?n )>>) AS ?e) }",
        f"SELECT {NATION} AS k, true AS t, {NATION} AS s, '{T}n_name' AS p, n_name AS o, true AS e FROM nation",
    ),
    "fn_case_digests": _sparql("SELECT ?k ?l ?a { ?k t:n_name ?n BIND(LCASE(?n) AS ?l) BIND(STRLEN(CONCAT(SHA384(?n), SHA512(?n))) AS ?a) }", f"SELECT {NATION} AS k, lower(n_name) AS l, CAST(224 AS BIGINT) AS a FROM nation"),
    # numbers
    "fn_division": _sparql(
        "SELECT ?p ?q ?i ?n { ?p t:p_size ?z BIND(STR(?z / 3) AS ?q) BIND(STR(1.0e0 / (?z - ?z)) AS ?i) BIND(COALESCE(?z / (?z - ?z), 'none') AS ?n) }",
        f"SELECT {PART} AS p, CASE p_size % 3 WHEN 0 THEN CAST(p_size // 3 AS VARCHAR) WHEN 1 THEN concat(p_size // 3, '.333333333333333333') ELSE concat(p_size // 3, '.666666666666666667') END AS q, 'INF' AS i, 'none' AS n FROM part",
    ),
    "fn_large_integers": _sparql(
        "SELECT ?p ?s ?m { ?p t:p_size ?z BIND(STRDT(CONCAT(STR(?z), '00000000000000000000'), xsd:integer) AS ?x) BIND(STR(?x + 1) AS ?s) BIND(STRDT(CONCAT(STR(?x), '0000000000000000000000'), xsd:integer) > ?x AS ?m) FILTER(?x >= 4000000000000000000000 && ?x != 4500000000000000000000) }",
        f"SELECT {PART} AS p, concat(p_size, '00000000000000000001') AS s, true AS m FROM part WHERE p_size >= 40 AND p_size <> 45",
    ),
    "fn_unary": _sparql("SELECT ?p ?a ?b { ?p t:p_size ?z BIND(+?z AS ?a) BIND(-(-?z) - ?z AS ?b) }", f"SELECT {PART} AS p, CAST(p_size AS BIGINT) AS a, CAST(0 AS BIGINT) AS b FROM part"),
    "fn_derived_casts": _sparql(
        "SELECT ?p ?a ?b ?c ?d ?e { ?p t:p_size ?z BIND(STR(xsd:byte(?z * 5)) AS ?a) BIND(STR(DATATYPE(xsd:unsignedShort(?z))) AS ?b) BIND(STR(xsd:negativeInteger(25 - ?z)) AS ?c) BIND(STR(xsd:float(?z)) AS ?d) BIND(xsd:boolean(?z - 11) AS ?e) }",
        f"SELECT {PART} AS p, CASE WHEN p_size * 5 <= 127 THEN CAST(p_size * 5 AS VARCHAR) END AS a, '{XSD}unsignedShort' AS b, CASE WHEN p_size > 25 THEN CAST(25 - p_size AS VARCHAR) END AS c, concat(p_size, '.0') AS d, p_size <> 11 AS e FROM part",
    ),
    "fn_truth": _sparql("SELECT ?p ?a ?b ?c { ?p t:p_size ?z ; t:p_name ?n BIND(IF(?z - 11, 1, 0) AS ?a) BIND(IF(?n, 1, 0) AS ?b) BIND(IF(STRAFTER(?n, 'nothing'), 1, 0) AS ?c) }", f"SELECT {PART} AS p, CAST(p_size <> 11 AS BIGINT) AS a, CAST(1 AS BIGINT) AS b, CAST(0 AS BIGINT) AS c FROM part"),
    # times
    "fn_zones": _sparql(
        f"SELECT ?o ?h ?m ?s ?day ?tz ?zone ?b {{ ?o t:o_orderdate ?d FILTER(YEAR(?d) = 1998) {ZONED} BIND(HOURS(?z) AS ?h) BIND(MINUTES(?z) AS ?m) BIND(STR(SECONDS(?z)) AS ?s) BIND(DAY(?z) AS ?day) BIND(TZ(?z) AS ?tz) BIND(STR(TIMEZONE(?z)) AS ?zone) BIND(?z < STRDT(CONCAT(SUBSTR(STR(?d), 1, 10), 'T05:00:00Z'), xsd:dateTime) AS ?b) }}",
        f"SELECT {ORDER} AS o, CAST(10 AS BIGINT) AS h, CAST(20 AS BIGINT) AS m, '30.5' AS s, CAST(day(o_orderdate) AS BIGINT) AS day, '+05:30' AS tz, 'PT5H30M' AS zone, true AS b FROM orders WHERE year(o_orderdate) = 1998",
    ),
    "fn_zones_of_constants": _sparql(
        "SELECT ?k ?h ?tz ?z ?s { ?k t:r_name ?n BIND(HOURS('2010-06-21T10:00:00-08:00'^^xsd:dateTime) AS ?h) BIND(TZ('2010-06-21T10:00:00-08:00'^^xsd:dateTime) AS ?tz) BIND(STR(TIMEZONE('2010-06-21T10:00:00Z'^^xsd:dateTime)) AS ?z) BIND(STR('2010-06-21T10:00:00+05:30'^^xsd:dateTime) AS ?s) }",
        f"SELECT {iri('region', 'r_regionkey')} AS k, CAST(10 AS BIGINT) AS h, '-08:00' AS tz, 'PT0S' AS z, '2010-06-21T10:00:00+05:30' AS s FROM region",
    ),
    "fn_durations": _sparql(
        "SELECT ?p ?e { ?p t:p_size ?z BIND(STRDT(CONCAT('PT', STR(?z), 'H'), xsd:dayTimeDuration) AS ?x) BIND(?x = 'P1DT10H'^^xsd:dayTimeDuration AS ?e) FILTER(?x > 'P1D'^^xsd:dayTimeDuration) }",
        f"SELECT {PART} AS p, p_size = 34 AS e FROM part WHERE p_size > 24",
    ),
    # patterns of rows
    "regex_dynamic": _sparql(
        "SELECT ?p ?f ?r { VALUES (?x ?f) { ('^RED' 'i') ('ring$' '') ('w.dget' '') } ?p t:p_name ?n FILTER(REGEX(?n, ?x, ?f)) BIND(REPLACE(?n, ?x, '<$0>', ?f) AS ?r) }",
        f"""SELECT {PART} AS p, 'i' AS f, regexp_replace(p_name, '^(RED)', '<\\1>', 'i') AS r FROM part WHERE regexp_matches(p_name, '^RED', 'i') UNION ALL
        SELECT {PART}, '', regexp_replace(p_name, '(ring)$', '<\\1>') FROM part WHERE regexp_matches(p_name, 'ring$') UNION ALL
        SELECT {PART}, '', regexp_replace(p_name, '(w.dget)', '<\\1>') FROM part WHERE regexp_matches(p_name, 'w.dget')""",
    ),
    "replace_empty_match": _sparql("SELECT ?k ?r { ?k t:n_name ?n BIND(COALESCE(REPLACE(?n, 'z*', '-'), 'error') AS ?r) }", f"SELECT {NATION} AS k, 'error' AS r FROM nation"),
}


def _quads(spark: SparkSession, d: str, *predicates: str) -> DataFrame:
    return durable(quads_of(engine(spark, d), [(p, "") for p in predicates]).distinct(), "quads")


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _register(name: str, sql: str | None):
    def put(f):
        QUERIES[name] = Registered(f, sql)
        return f

    return put


# updates
_COUNTS = lambda q: q.groupBy("g", "p").agg(F.count("*").alias("n"))


@_register("update_data", f"SELECT {iri('region', 'r_regionkey')} AS s, '{T}r_name' AS p, r_name AS o FROM region WHERE r_regionkey <> 1 UNION ALL SELECT '{T}region/9', '{T}r_name', 'NOWHERE'")
def _update_data(spark, d):
    e = Engine(QuadGraph(_quads(spark, d, "r_name")), PREFIXES)
    name = spark.read.parquet(f"{d}/region.parquet").where("r_regionkey = 1").first().r_name
    return _terms(e.update(f"INSERT DATA {{ <{T}region/9> t:r_name 'NOWHERE' }} ; DELETE DATA {{ <{T}region/1> t:r_name '{name}' }}").quads)


@_register(
    "update_graphs",
    f"""SELECT '{T}b' AS g, '{T}n_name' AS p, count(*) AS n FROM nation UNION ALL SELECT '{T}b', '{T}r_name', count(*) FROM region UNION ALL SELECT '{T}c', '{T}n_name', count(*) FROM nation""",
)
def _update_graphs(spark, d):
    e = Engine(QuadGraph(_quads(spark, d, "n_name")), PREFIXES)
    text = "CREATE GRAPH t:new ; ADD DEFAULT TO t:a ; COPY t:a TO t:c ; INSERT { GRAPH t:a { ?r t:r_name ?x } } WHERE { SERVICE <urn:regions> { ?r t:r_name ?x } } ; MOVE t:a TO t:b ; CLEAR DEFAULT ; DROP SILENT GRAPH t:absent ; CLEAR SILENT GRAPH t:a"
    own = Engine(e.graph, PREFIXES, services={"urn:regions": engine(spark, d).graph})
    return _COUNTS(own.update(text).quads)


@_register("update_using", f"SELECT '{T}to' AS g, '{T}big' AS p, count(*) AS n FROM nation WHERE n_regionkey = 1 UNION ALL SELECT '{T}from', '{T}n_regionkey', count(*) FROM nation")
def _update_using(spark, d):
    quads = _quads(spark, d, "n_regionkey").withColumn("g", F.lit(T + "from"))
    e = Engine(QuadGraph(quads), PREFIXES)
    return _COUNTS(e.update(f"WITH t:to INSERT {{ ?n t:big true }} USING t:from WHERE {{ ?n t:n_regionkey <{T}region/1> }} ; WITH t:to DELETE {{ ?n t:small ?x }} WHERE {{ ?n t:small ?x }}").quads)


@_register("update_mapped", f"SELECT {NATION} AS s, '{T}n_name' AS p, CASE n_regionkey WHEN 1 THEN 'renamed' ELSE n_name END AS o FROM nation")
def _update_mapped(spark, d):
    after = engine(spark, d).update(f"DELETE {{ ?n t:n_name ?x }} INSERT {{ ?n t:n_name 'renamed' }} WHERE {{ ?n t:n_regionkey <{T}region/1> ; t:n_name ?x }}")
    return _terms(after.quads.where(F.col("p") == T + "n_name"))


@_register("update_load", f"SELECT '{T}loaded' AS g, '{T}n_name' AS p, count(*) AS n FROM nation")
def _update_load(spark, d):
    quads = _quads(spark, d, "n_name")
    path = f"{quads._quadloom_path}-{uuid.uuid4().hex}.nt"
    ntriples.write(quads, path)
    return _COUNTS(Engine(QuadGraph(quads.where("false")), PREFIXES).update(f"LOAD <{path}> INTO GRAPH t:loaded ; LOAD SILENT <file:///nothing/there.nt>").quads)


@_register("update_union_default", f"SELECT '' AS g, '{T}seen' AS p, count(*) AS n FROM nation UNION ALL SELECT concat('{T}g', k), '{T}n_name', count(*) FROM nation, (VALUES (0), (1)) v(k) GROUP BY 1")
def _update_union(spark, d):
    quads = _quads(spark, d, "n_name")
    both = quads.withColumn("g", F.lit(T + "g0")).unionByName(quads.withColumn("g", F.lit(T + "g1")))
    return _COUNTS(Engine(QuadGraph(both, default_union=True), PREFIXES).update("INSERT { ?n t:seen true } WHERE { ?n t:n_name ?x }").quads)


@_register("union_default_graph", "SELECT count(*) AS n FROM nation")
def _union_default(spark, d):
    quads = _quads(spark, d, "n_name")
    both = quads.withColumn("g", F.lit(T + "g0")).unionByName(quads.withColumn("g", F.lit(T + "g1")))
    return Engine(QuadGraph(both, default_union=True), PREFIXES).select("SELECT (COUNT(*) AS ?n) { ?s ?p ?o }")


@_register("service_local", f"SELECT {NATION} AS k, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey")
def _service(spark, d):
    e = Engine(QuadGraph(_quads(spark, d, "n_regionkey")), PREFIXES, services={"urn:regions": engine(spark, d).graph})
    return e.select("SELECT ?k ?r { ?k t:n_regionkey ?g SERVICE <urn:regions> { ?g t:r_name ?r } SERVICE SILENT <urn:absent> { ?x t:nothing ?y } }", lexical_forms=True)


# graphs as values
@_register("initial_bindings", f"SELECT {NATION} AS k FROM nation WHERE n_regionkey = 2")
def _bindings(spark, d):
    g = RdfGraph(spark, _quads(spark, d, "n_regionkey"), PREFIXES)
    return g.query("SELECT ?k { ?k t:n_regionkey ?g }", {"g": IRI(T + "region/2")}).select(F.col("k")["v"].alias("k"))


@_register(
    "graph_api",
    f"""SELECT 'match' AS what, count(*) AS n FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'subjects', count(*) FROM nation UNION ALL SELECT 'predicates', 2 UNION ALL SELECT 'objects', count(DISTINCT n_regionkey) FROM nation
    UNION ALL SELECT 'predicate_objects', 2 UNION ALL SELECT 'subject_objects', count(*) FROM nation UNION ALL SELECT 'subject_predicates', count(*) FROM nation WHERE n_regionkey = 1
    UNION ALL SELECT 'added', 2 * count(*) + 1 FROM nation UNION ALL SELECT 'removed', count(*) FROM nation UNION ALL SELECT 'has', 1 UNION ALL SELECT 'graphs', 1 UNION ALL SELECT 'merged', 2 * count(*) FROM nation UNION ALL SELECT 'overlap', 2 * count(*) FROM nation""",
)
def _graph_api(spark, d):
    g = RdfGraph(spark, _quads(spark, d, "n_regionkey", "n_name"), PREFIXES)
    one, region = IRI(T + "region/1"), IRI(T + "n_regionkey")
    more = Triple(IRI(T + "nation/99"), region, one)
    two = RdfGraph(spark, g.quads.unionByName(g.quads.withColumn("g", F.lit(T + "copy"))), PREFIXES)
    frames = {"match": g.match(None, region, one), "subjects": g.subjects(region), "predicates": g.predicates(), "objects": g.objects(None, region), "predicate_objects": g.predicate_objects(IRI(T + "nation/3")), "subject_objects": g.subject_objects(region), "subject_predicates": g.subject_predicates(one), "added": g.add(more).quads, "removed": g.remove(p=region).quads, "merged": two.merged().quads, "overlap": two.overlap()}
    rows = [(k, v.count()) for k, v in frames.items()] + [("has", int(more in g.add(more) and more not in g)), ("graphs", len(two.graph_names()))]
    return _rows(spark, rows, "what string, n long")


@_register("turtle_round_trip", f"SELECT {iri('region', 'r_regionkey')} AS s, '{T}r_name' AS p, r_name AS o FROM region")
def _turtle(spark, d):
    g = RdfGraph(spark, _quads(spark, d, "r_name"), PREFIXES)
    return _terms(RdfGraph(spark, prefixes=PREFIXES).parse(data=g.serialize(format="turtle"), format="turtle").quads)


@_register("document_formats", f"SELECT form, {iri('region', 'r_regionkey')} AS s, '{T}r_name' AS p, r_name AS o FROM region, (VALUES ('rdfxml'), ('jsonld')) v(form)")
def _documents(spark, d):
    rows = [(r.r_regionkey, r.r_name) for r in spark.read.parquet(f"{d}/region.parquet").collect()]
    xml = "".join(f'<rdf:Description rdf:about="region/{k}"><t:r_name>{n}</t:r_name></rdf:Description>' for k, n in rows)
    texts = {"rdfxml": f'<rdf:RDF xmlns:rdf="{RDF}" xmlns:t="{T}" xml:base="{T}">{xml}</rdf:RDF>', "jsonld": json.dumps({"@context": {"name": T + "r_name", "@base": T}, "@graph": [{"@id": f"region/{k}", "name": n} for k, n in rows]})}
    parts = [_terms(RdfGraph(spark, prefixes=PREFIXES).parse(data=t, format=form).quads).withColumn("form", F.lit(form)) for form, t in texts.items()]
    return parts[0].unionByName(parts[1])


@_register("blank_nodes", "SELECT 'skolem' AS what, count(*) AS n FROM nation UNION ALL SELECT 'back', count(*) FROM nation UNION ALL SELECT 'isomorphic', 1 UNION ALL SELECT 'different', 0")
def _blank(spark, d):
    data = durable(engine(spark, d).construct("CONSTRUCT { _:b t:names ?n ; t:of ?k } WHERE { ?k t:n_name ?n }"), "blank")
    told = setops.skolemised(data, "urn:skolem:")
    back = setops.deskolemised(told, "urn:skolem:")
    other = durable(data.select("g", F.struct(F.lit(1).alias("k"), F.concat(F.lit("x"), F.col("s")["v"]).alias("v"), F.lit("").alias("dt"), F.lit("").alias("lang"), F.lit("").alias("dir")).alias("s"), "p", "o"), "renamed")
    rows = [("skolem", told.where("s.v like 'urn:skolem:%'").select("s").distinct().count()), ("back", back.intersect(data.select(back.columns)).select("s").distinct().count())]
    rows += [("isomorphic", int(setops.isomorphic(data, other))), ("different", int(setops.isomorphic(data, other.where(F.col("p") == T + "names"))))]
    return _rows(spark, rows, "what string, n long")


@_register("list_members", f"SELECT CAST(n - 1 AS INTEGER) AS position, concat('m', n) AS member FROM (SELECT unnest(range(1, 6)) AS n)")
def _lists(spark, d):
    g = RdfGraph(spark, prefixes=PREFIXES).parse(data="t:x t:list ( 'm1' 'm2' 'm3' 'm4' 'm5' ) .", format="turtle")
    return setops.list_members(g.quads).select("position", F.col("member")["v"].alias("member"))


@_register("collection_pattern", "SELECT 'https://example.org/t/a' AS x, '2' AS y")
def _collection(spark, d):
    g = RdfGraph(spark, prefixes=PREFIXES).parse(data="t:a t:l ( 1 2 ) ; t:b [ t:c 2 ] . t:z t:l ( 1 ) .", format="turtle")
    return g.engine.select("SELECT ?x ?y { ?x t:l ( 1 ?y ) ; t:b [ t:c ?y ] }", lexical_forms=True)


@_register("prepared_query", f"SELECT {NATION} AS k FROM nation WHERE n_regionkey IN (2, 3)")
def _prepared(spark, d):
    run = RdfGraph(spark, _quads(spark, d, "n_regionkey"), PREFIXES).prepare("SELECT ?k { ?k t:n_regionkey ?g }")
    return run({"g": IRI(T + "region/2")}).unionByName(run({"g": IRI(T + "region/3")})).select(F.col("k")["v"].alias("k"))


@_register("path_of_graph", f"SELECT {CUSTOMER} AS s, {REGION} AS o FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _path_api(spark, d):
    found = RdfGraph(spark, _quads(spark, d, "c_nationkey", "n_regionkey"), PREFIXES).path("t:c_nationkey/t:n_regionkey")
    return found.select(F.col("s")["v"].alias("s"), F.col("o")["v"].alias("o"))


@_register("result_lines", f"""SELECT concat('<', {NATION}, '>', chr(9), '"', n_name, '"') AS value FROM nation UNION ALL SELECT concat({NATION}, ',', n_name) FROM nation""")
def _lines(spark, d):
    g = RdfGraph(spark, _quads(spark, d, "n_name"), PREFIXES)
    text = "SELECT ?k ?n { ?k t:n_name ?n }"
    return g.result_lines(text).unionByName(g.result_lines(text, "csv"))


@_register("base_directions", f"SELECT 'encoded' AS what, concat('{setops.DIRECTIONS}', 'he--rtl') AS told, count(*) AS n FROM nation UNION ALL SELECT 'decoded', 'he--rtl', count(*) FROM nation UNION ALL SELECT 'dropped', 'he--', count(*) FROM nation")
def _directions(spark, d):
    quads = durable(engine(spark, d).construct("CONSTRUCT { ?k t:label ?x } WHERE { ?k t:n_name ?n BIND(STRLANGDIR(?n, 'he', 'rtl') AS ?x) }"), "directed")
    told = setops.to_rdf11(quads)
    tag = F.concat(F.col("o")["lang"], F.lit("--"), F.col("o")["dir"])
    parts = [told.select(F.lit("encoded").alias("what"), F.col("o")["dt"].alias("told")), setops.decode_directions(told).select(F.lit("decoded").alias("what"), tag.alias("told")), setops.encode_directions(quads, "drop").select(F.lit("dropped").alias("what"), tag.alias("told"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("what", "told").agg(F.count("*").alias("n"))


@_register("short_names", f"SELECT concat('q:', n_nationkey) AS short, {NATION} AS long, concat('<', {NATION}, '>') AS text FROM nation")
def _names(spark, d):
    prefixes = {"t": T, "q": T + "nation/"}
    s = _quads(spark, d, "n_name").select("s", names.qname(F.col("s")["v"], prefixes).alias("short"))
    return s.select("short", names.expand_curie(F.col("short"), prefixes).alias("long"), names.n3(F.col("s")).alias("text"))


@_register("owl_imports", f"SELECT '{T}n_name' AS p, count(*) AS n FROM nation UNION ALL SELECT '{T}r_name', count(*) FROM region")
def _imports(spark, d):
    """The data import the names of nations, and these those of regions, which import the first again."""
    link = lambda a, b: RdfGraph(spark, prefixes=PREFIXES).parse(data=f"t:{a} owl:imports t:{b} .", format="turtle").quads
    modules = {T + "nations": _quads(spark, d, "n_name").unionByName(link("nations", "regions")), T + "regions": _quads(spark, d, "r_name").unionByName(link("regions", "nations")).unionByName(link("regions", "absent"))}
    made = names.resolve_imports(link("data", "nations"), modules.get, "delta")
    return made.where(F.col("p") != names.IMPORTS).groupBy("p").agg(F.count("*").alias("n"))


# reifiers
@_register(
    "reification_api",
    """SELECT what, CAST(n AS BIGINT) AS n FROM (SELECT 'reifiers' AS what, count(*) AS n FROM nation UNION ALL SELECT 'reifications', count(*) FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'terms', count(*) FROM nation
    UNION ALL SELECT 'of one', 1 UNION ALL SELECT 'said', count(*) FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'removed', count(*) - 1 FROM nation UNION ALL SELECT 'has', 1 UNION ALL SELECT 'added', 1)""",
)
def _reification(spark, d):
    plain = _quads(spark, d, "n_regionkey")
    quads = durable(reification.reify(plain, plain), "reified")
    three = quads.where((F.col("p") == T + "n_regionkey") & (F.col("s")["v"] == T + "nation/3")).first()
    term = TripleTerm(IRI(T + "nation/3"), IRI(T + "n_regionkey"), IRI(three.o.v))
    mine, named = reification.reifiers(quads, term), IRI(T + "note")
    more = reification.add_reification(quads, named, term)
    rows = [
        ("reifiers", reification.reifiers(quads).count()),
        ("reifications", reification.reifications(quads, None, IRI(T + "n_regionkey"), IRI(T + "region/1")).count()),
        ("terms", reification.triple_terms(quads).count()),
        ("of one", mine.count()),
        ("said", reification.parts(reification.reified_triples(more, named)).count()),
        ("removed", reification.triple_terms(reification.remove_reification(reification.remove_reification(more, named), named, term).join(mine.withColumnRenamed("reifier", "s"), "s", "left_anti").select("g", "s", "p", "o")).count()),
        ("has", int(reification.has_triple_term(quads, term.s, term.p, term.o))),
        ("added", reification.reifiers(more, term, IRI(RDF + "reifies")).count() - mine.count()),
    ]
    return _rows(spark, rows, "what string, n long")


@_register("annotation_syntax", f"SELECT {NATION} AS k, {REGION} AS g, 'sure' AS x FROM nation")
def _annotated(spark, d):
    quads = durable(engine(spark, d).construct("CONSTRUCT { ?k t:in ?g . ?r rdf:reifies <<( ?k t:in ?g )>> ; t:how 'sure' } WHERE { ?k t:n_regionkey ?g BIND(IRI(CONCAT(STR(?k), '/note')) AS ?r) }"), "notes")
    return Engine(QuadGraph(quads), PREFIXES).select("SELECT ?k ?g ?x { ?k t:in ?g {| t:how ?x |} }", lexical_forms=True)


# shapes
def _components(sql: dict[str, str]) -> str:
    return "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{name}ConstraintComponent' AS component, count(*) AS n FROM {body}" for name, body in sql.items()) + ") WHERE n > 0"


def _by_component(found: DataFrame) -> DataFrame:
    return found.groupBy(F.regexp_replace("component", ".*#", "").alias("component")).agg(F.count("*").alias("n"))


def _shapes(name: str, text: str, sql: dict[str, str]) -> None:
    _register(name, _components(sql))(lambda spark, d: _by_component(shacl.validate(engine(spark, d), text)))


_shapes(
    "shacl_values",
    """t:S sh:targetClass t:Part ; sh:property [ sh:path t:p_size ; sh:nodeKind sh:IRI ; sh:maxInclusive 30 ; sh:maxExclusive 40 ] , [ sh:path t:p_name ; sh:pattern "^[A-M]" ; sh:flags "i" ; sh:singleLine true ; sh:nodeKind sh:Literal ] .
    t:D sh:targetClass t:Document ; sh:property [ sh:path t:documents_text ; sh:languageIn ( "fr" "en" ) ; sh:singleLine true ] .""",
    {
        "NodeKind": "part",
        "MaxInclusive": "part WHERE p_size > 30",
        "MaxExclusive": "part WHERE p_size >= 40",
        "Pattern": "part WHERE NOT regexp_matches(p_name, '^[A-M]', 'i')",
        "LanguageIn": "documents WHERE text IS NOT NULL AND (lang IS NULL OR lang NOT IN ('fr', 'en'))",
        "SingleLine": "documents WHERE regexp_matches(text, '[\\r\\n]')",
    },
)
_shapes(
    "shacl_pairs",
    """t:L sh:targetSubjectsOf t:labels_toxic ; sh:property [ sh:path t:labels_toxic ; sh:lessThan t:labels_quality ; sh:lessThanOrEquals t:labels_quality ] .
    t:P sh:targetClass t:Part ; sh:property [ sh:path t:p_name ; sh:equals t:p_type ; sh:disjoint t:p_name ; sh:subsetOf t:p_brand ] .""",
    {"LessThan": "labels WHERE NOT toxic < quality", "LessThanOrEquals": "labels WHERE NOT toxic <= quality", "Equals": "part, (VALUES (1), (2)) v(x)", "Disjoint": "part", "SubsetOf": "part"},
)
_shapes(
    "shacl_logic",
    """t:S sh:targetClass t:Part ; sh:property
      [ sh:path t:p_size ; sh:and ( [ sh:minInclusive 10 ] [ sh:maxInclusive 40 ] ) ; sh:xone ( [ sh:maxInclusive 20 ] [ sh:minInclusive 15 ] ) ; sh:node t:Even ] .
    t:Even sh:minInclusive 5 .
    t:C sh:targetClass t:Customer ; sh:property [ sh:path [ sh:inversePath t:o_custkey ] ; sh:qualifiedValueShape [ sh:property [ sh:path t:o_orderstatus ; sh:hasValue "P" ] ] ; sh:qualifiedMinCount 2 ; sh:qualifiedMaxCount 5 ] ,
      [ sh:path [ sh:inversePath t:o_custkey ] ; sh:someValue [ sh:property [ sh:path t:o_totalprice ; sh:minInclusive 400000 ] ] ] .
    t:R sh:targetClass t:Region ; sh:closed true ; sh:ignoredProperties ( rdf:type ) .""",
    {
        "And": "part WHERE p_size < 10 OR p_size > 40",
        "Xone": "part WHERE (p_size <= 20) = (p_size >= 15)",
        "Node": "part WHERE p_size < 5",
        "QualifiedMinCount": "customer WHERE (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') < 2",
        "QualifiedMaxCount": "customer WHERE (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') > 5",
        "SomeValue": "customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice >= 400000)",
        "Closed": "region",
    },
)
_shapes(
    "shacl_targets",
    f"""t:A sh:targetSubjectsOf t:r_name ; sh:minLength 1000 . t:B sh:targetObjectsOf t:n_regionkey ; sh:maxLength 3 . t:C sh:targetNode <{T}nation/3> , <{T}nation/4> ; sh:property [ sh:path t:none ; sh:minCount 1 ] .""",
    {"MinLength": "region", "MaxLength": "(SELECT DISTINCT n_regionkey FROM nation)", "MinCount": "nation WHERE n_nationkey IN (3, 4)"},
)


@_register("shacl_unique", _components({"UniqueValuesFor": "customer WHERE (c_mktsegment, c_nationkey) IN (SELECT (c_mktsegment, c_nationkey) FROM customer GROUP BY c_mktsegment, c_nationkey HAVING count(*) > 1)", "UniqueLang": "nation", "RootClass": "nation"}))
def _shacl_unique(spark, d):
    e = engine(spark, d)
    quads = e.construct("CONSTRUCT { ?c a t:Customer ; t:seg ?s ; t:nat ?k } WHERE { ?c t:c_mktsegment ?s ; t:c_nationkey ?k }")
    names = e.construct("CONSTRUCT { ?k a t:Nation ; t:label ?x , ?y ; t:kind t:Land . t:Land rdfs:subClassOf t:Place } WHERE { ?k t:n_name ?n BIND(STRLANG(?n, 'en') AS ?x) BIND(STRLANG(CONCAT(?n, '!'), 'EN') AS ?y) }")
    g = Engine(QuadGraph(durable(quads.unionByName(names).distinct(), "unique")), PREFIXES)
    return _by_component(shacl.validate(g, "t:S sh:targetClass t:Customer ; sh:uniqueValuesFor ( t:seg t:nat ) . t:N sh:targetClass t:Nation ; sh:property [ sh:path t:label ; sh:uniqueLang true ] , [ sh:path t:kind ; sh:rootClass t:Animal ] , [ sh:path t:kind ; sh:rootClass t:Place ] ."))


@_register(
    "shacl_lists_and_reifiers",
    _components({"MinListLength": "region WHERE r_regionkey < 2", "MaxListLength": "region WHERE r_regionkey > 2", "UniqueMembers": "region WHERE r_regionkey > 1", "MemberShape": "region WHERE r_regionkey > 0", "ReificationRequired": "nation WHERE n_regionkey <> 1", "ReifierShape": "nation WHERE n_regionkey = 1", "Expression": "nation WHERE n_regionkey = 1", "NodeByExpression": "nation WHERE n_regionkey <> 1"}),
)
def _shacl_lists(spark, d):
    """Regions hold lists as long as their key, all of the same member; nations of region 1 have a note."""
    e = engine(spark, d)
    nil, cell = f"<{RDF}nil>", "t:cell{}-{}"
    lists = " ".join(f"t:r{k} a t:Lister ; t:list {cell.format(k, 0) if k else nil} ." + "".join(f" {cell.format(k, i)} rdf:first 'm' ; rdf:rest {cell.format(k, i + 1) if i + 1 < k else nil} ." for i in range(k)) for k in range(5))
    small = RdfGraph(spark, prefixes=PREFIXES).parse(data=lists, format="turtle").quads
    notes = e.construct(f"CONSTRUCT {{ ?k a t:Nation ; t:in ?g ; t:mark ?m . ?r rdf:reifies ?t ; t:by 'me' }} WHERE {{ ?k t:n_regionkey ?g BIND(?g = <{T}region/1> AS ?m) BIND(IF(?m, IRI(CONCAT(STR(?k), '/note')), 1) AS ?r) BIND(IF(?m, TRIPLE(?k, t:in, ?g), 1) AS ?t) }}")
    g = Engine(QuadGraph(durable(small.unionByName(notes).distinct(), "lists")), PREFIXES)
    shapes = """t:L sh:targetClass t:Lister ; sh:property [ sh:path t:list ; sh:minListLength 2 ; sh:maxListLength 2 ; sh:uniqueMembers true ; sh:memberShape [ sh:minLength 2 ] ] .
    t:N sh:targetClass t:Nation ; sh:property [ sh:path t:in ; sh:reificationRequired true ; sh:reifierShape [ sh:property [ sh:path t:date ; sh:minCount 1 ] ] ] ;
      sh:expression [ q:not-equals ( [ x:pathValues t:mark ] true ) ] ; sh:nodeByExpression [ x:if [ x:pathValues t:mark ] ; x:then t:Any ; x:else t:None ] .
    t:Any sh:nodeKind sh:IRI . t:None sh:nodeKind sh:Literal ."""
    return _by_component(shacl.validate(g, shapes, PREFIXES | {"x": "http://www.w3.org/ns/shacl-node-expr#", "q": "http://www.w3.org/ns/sparql#"}))


@_register("shacl_options", "SELECT 'MinInclusiveConstraintComponent' AS component, count(*) AS n FROM part WHERE p_partkey IN (1, 2, 3)")
def _shacl_options(spark, d):
    text = "t:A sh:targetClass t:Part ; sh:property [ sh:path t:p_size ; sh:minInclusive 1000 ; sh:severity sh:Warning ] , [ sh:path t:p_size ; sh:maxInclusive 0 ; sh:severity sh:Info ] . t:B sh:targetClass t:Part ; sh:property [ sh:path t:p_name ; sh:maxLength 0 ] ."
    return _by_component(shacl.validate(engine(spark, d), text, only=[T + "A"], focus=[f"{T}part/{k}" for k in (1, 2, 3)], least="Warning", limit=1000))


@_register("skos_conditions", "SELECT 'S13' AS condition, count(*) AS n FROM nation UNION ALL SELECT 'S14', count(*) FROM nation UNION ALL SELECT 'S27', count(*) FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'S9', count(*) FROM region UNION ALL SELECT 'S46', 2 * count(*) FROM nation WHERE n_regionkey = 2")
def _skos(spark, d):
    """Nations below their region; those of region 1 are related to a node above, those of region 2 match one in two ways."""
    text = """PREFIX k: <http://www.w3.org/2004/02/skos/core#> CONSTRUCT { ?n a k:Concept ; k:prefLabel ?x , ?y ; k:altLabel ?y ; k:broader ?up . ?up k:broader t:top . ?g a k:Concept , k:ConceptScheme . ?r k:related ?own . ?own k:broader ?r . ?m k:exactMatch ?far ; k:broadMatch ?far }
    WHERE { ?n t:n_name ?name ; t:n_regionkey ?g . BIND(STRLANG(?name, 'en') AS ?x) BIND(STRLANG(CONCAT(?name, '!'), 'en') AS ?y) BIND(IRI(CONCAT(STR(?n), '/up')) AS ?up)
    BIND(IF(?g = <https://example.org/t/region/1>, IRI(CONCAT(STR(?n), '/r')), 1) AS ?r) BIND(IRI(CONCAT(STR(?n), '/own')) AS ?own0) BIND(IF(isIRI(?r), ?own0, 1) AS ?own)
    BIND(IF(?g = <https://example.org/t/region/2>, IRI(CONCAT(STR(?n), '/m')), 1) AS ?m) BIND(IRI(CONCAT(STR(?n), '/far')) AS ?far0) BIND(IF(isIRI(?m), ?far0, 1) AS ?far) }"""
    data = durable(engine(spark, d).construct(text), "skos")
    return skos.check(Engine(QuadGraph(data), PREFIXES)).groupBy("condition").agg(F.count_distinct("node").alias("n"))


@_register("stored_graph", f"SELECT {NATION} AS k, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey <> 3 AND n_regionkey <> 4")
def _stored(spark, d):
    """Added in two parts, one of them twice, and less by the nation 3 and what region 4 is called."""
    a, b = _quads(spark, d, "n_regionkey", "n_name"), _quads(spark, d, "r_name")
    store = Store(spark, f"{a._quadloom_path}-store-{uuid.uuid4().hex}")
    store.add(a)
    store.add(b.unionByName(a))
    store.remove(a.where(F.col("s")["v"] == T + "nation/3").unionByName(b.where(F.col("s")["v"] == T + "region/4")))
    return Engine(store.graph(), PREFIXES).select("SELECT ?k ?r { ?k t:n_regionkey ?g . ?g t:r_name ?r }", lexical_forms=True)


# node expressions, each for all regions at once
_EXPRESSIONS = {
    "if": ("[ x:if [ x:exists [ x:pathValues [ sh:inversePath t:n_regionkey ] ] ] ; x:then 'yes' ; x:else 'no' ]", "SELECT r_regionkey AS r, 0 AS pos, 'yes' AS node FROM region"),
    "concat": ("[ x:concat ( 'a' [ x:pathValues t:r_name ] 'a' ) ]", "SELECT r_regionkey, unnest([0, 1, 2]), unnest(['a', r_name, 'a']) FROM region"),
    "distinct": ("[ x:distinct [ x:concat ( 'b' 'a' 'b' ) ] ]", "SELECT r_regionkey, unnest([0, 1]), unnest(['b', 'a']) FROM region"),
    "intersection": ("[ x:intersection ( [ x:concat ( 'a' [ x:pathValues t:r_name ] ) ] [ x:concat ( 'ASIA' 'a' ) ] ) ]", "SELECT r_regionkey, 0, 'a' FROM region UNION ALL SELECT r_regionkey, 1, r_name FROM region WHERE r_name = 'ASIA'"),
    "remove": ("[ x:remove 'ASIA' ; x:nodes [ x:pathValues t:r_name ] ]", "SELECT r_regionkey, 0, r_name FROM region WHERE r_name <> 'ASIA'"),
    "limit": ("[ x:limit 1 ; x:nodes [ x:offset 1 ; x:nodes [ x:orderBy sh:this ; x:desc true ; x:nodes [ x:flatMap [ x:pathValues t:n_name ] ; x:nodes [ x:pathValues [ sh:inversePath t:n_regionkey ] ] ] ] ] ]", "SELECT r_regionkey, 0, (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey ORDER BY n_name DESC LIMIT 1 OFFSET 1) FROM region"),
    "findFirst": ("[ x:findFirst [ sh:pattern '2' ] ; x:nodes [ x:flatMap [ x:pathValues t:n_name ] ; x:nodes [ x:pathValues [ sh:inversePath t:n_regionkey ] ] ] ]", "SELECT r_regionkey, 0, n_name FROM (SELECT r_regionkey, n_name, row_number() OVER (PARTITION BY r_regionkey ORDER BY concat('x/', n_nationkey)) AS k FROM region JOIN nation ON n_regionkey = r_regionkey WHERE contains(n_name, '2')) WHERE k = 1"),
    "matchAll": ("[ x:matchAll [ sh:pattern '^A' ] ; x:nodes [ x:pathValues t:r_name ] ]", "SELECT r_regionkey, 0, CASE WHEN r_name LIKE 'A%' THEN 'true' ELSE 'false' END FROM region"),
    "extrema": ("[ x:concat ( [ x:min [ x:concat ( 3 1 2 ) ] ] [ x:max [ x:concat ( 3 1 2 ) ] ] [ x:sum [ x:concat ( 3 1 2 ) ] ] ) ]", "SELECT r_regionkey, unnest([0, 1, 2]), unnest(['1', '3', '6']) FROM region"),
    "instances": ("[ x:count [ x:instancesOf t:Land ] ]", "SELECT r_regionkey, 0, (SELECT CAST(count(*) AS VARCHAR) FROM nation) FROM region"),
    "nodesMatching": ("[ x:count [ x:nodesMatching [ sh:property [ sh:path t:r_name ; sh:minCount 1 ] ] ] ]", "SELECT r_regionkey, 0, (SELECT CAST(count(*) AS VARCHAR) FROM region) FROM region"),
    "conformsToShape": ("[ x:conformsToShape ( sh:this t:Asian ) ]", "SELECT r_regionkey, 0, CASE WHEN r_name = 'ASIA' THEN 'true' ELSE 'false' END FROM region"),
    "calls": ("[ q:concat ( [ q:lcase ( [ x:pathValues t:r_name ] ) ] '-' [ q:str ( [ q:strlen ( [ x:pathValues t:r_name ] ) ] ) ] ) ]", "SELECT r_regionkey, 0, concat(lower(r_name), '-', length(r_name)) FROM region"),
    "operators": ("[ q:if ( [ q:logical-and ( [ q:less-than ( [ q:strlen ( [ x:pathValues t:r_name ] ) ] 7 ) ] [ q:bound ( [ x:pathValues t:r_name ] ) ] ) ] 'short' [ q:coalesce ( [ x:pathValues t:none ] 'long' ) ] ) ]", "SELECT r_regionkey, 0, CASE WHEN length(r_name) < 7 THEN 'short' ELSE 'long' END FROM region"),
    "select": ("[ sh:select 'SELECT ?n { ?k t:n_regionkey $this ; t:n_name ?n FILTER(CONTAINS(?n, \"7\")) }' ]", "SELECT r_regionkey, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_name) - 1, n_name FROM region JOIN nation ON n_regionkey = r_regionkey WHERE contains(n_name, '7')"),
    "sparqlExpr": ("[ sh:sparqlExpr 'STRAFTER(STR($this), \"region/\")' ]", "SELECT r_regionkey, 0, CAST(r_regionkey AS VARCHAR) FROM region"),
    "function": ("[ t:twice [ x:pathValues t:r_name ] ; t:word [ x:pathValues t:r_name ] ]", "SELECT r_regionkey, 0, concat(r_name, r_name) FROM region"),
}


@_register("node_expressions", " UNION ALL ".join(f"SELECT '{name}' AS name, concat('{T}region/', x.c0) AS r, CAST(x.c1 AS INTEGER) AS pos, x.c2 AS node FROM ({sql}) x(c0, c1, c2)" for name, (_, sql) in _EXPRESSIONS.items()))
def _node_expressions(spark, d):
    quads = durable(quads_of(engine(spark, d), [("r_name", ""), ("n_name", ""), ("n_regionkey", "")]).unionByName(engine(spark, d).construct("CONSTRUCT { ?k a t:Land } WHERE { ?k t:n_name ?n }")).distinct(), "expressions")
    prefixes = PREFIXES | {"x": "http://www.w3.org/ns/shacl-node-expr#", "q": "http://www.w3.org/ns/sparql#"}
    holders = " ".join(f"t:h{i} t:is {text} ." for i, (text, _) in enumerate(_EXPRESSIONS.values()))
    more = "t:Asian sh:property [ sh:path t:r_name ; sh:hasValue 'ASIA' ] . t:twice a sh:NamedParameterExpressionFunction ; sh:parameter [ sh:path t:word ] ; sh:bodyExpression [ q:concat ( [ x:arg t:word ] [ x:arg t:word ] ) ] ."
    v = shacl.Validator(Engine(QuadGraph(quads), prefixes), shacl.Shapes(f"{holders} {more}", prefixes))
    every = v.engine.graph.scan([Triple(Var("focus"), IRI(T + "r_name"), Var("n"))]).keep(["focus"])
    out = None
    for i, name in enumerate(_EXPRESSIONS):
        found = values_of(v, v.shapes.facts[IRI(f"{T}h{i}")][T + "is"][0], every)
        own = found.select(F.lit(name).alias("name"), F.col("focus")["v"].alias("r"), F.col("pos").cast("int").alias("pos"), F.col("node")["v"].alias("node"))
        out = own if out is None else out.unionByName(own)
    return out


# rules
@_register("srl_group", f"SELECT {iri('region', 'r_regionkey')} AS s, '{T}nations' AS p, CAST(count(*) AS VARCHAR) AS o FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey UNION ALL SELECT '{T}all', '{T}nations', CAST(count(*) AS VARCHAR) FROM nation UNION ALL SELECT '{T}all', '{T}first', min(n_name) FROM nation")
def _srl_group(spark, d):
    rules = "RULE { ?r t:nations ?n } WHERE { GROUP BY ?r { ?k t:n_regionkey ?r } [ ?n := COUNT(*) ] } RULE { t:all t:nations ?n ; t:first ?m } WHERE { GROUP { ?k t:n_name ?x } [ ?n := COUNT(DISTINCT ?k) , ?m := MIN(?x) ] } RULE { t:none t:low ?m } WHERE { GROUP { ?k t:nothing ?x } [ ?m := MAX(?x) ] }"
    return _terms(RuleSet(rules, PREFIXES).infer(QuadGraph(_quads(spark, d, "n_regionkey", "n_name")), delta=True))


@_register("srl_not_data", f"SELECT {NATION} AS s, '{T}far' AS p, CAST(length(n_name) + 1 AS VARCHAR) AS o FROM nation WHERE n_regionkey = 1 UNION ALL SELECT {NATION}, '{T}new', 'true' FROM nation UNION ALL SELECT '{T}x', '{T}given', '1'")
def _srl_not_data(spark, d):
    rules = f"""DATA {{ t:x t:given 1 }}
    RULE {{ ?k t:far ?n }} WHERE {{ ?k t:n_regionkey <{T}region/1> ; t:n_name ?x . FILTER(STRLEN(?x) > 2) SET(?n := STRLEN(?x) + 1) }}
    RULE {{ ?k t:new true }} WHERE {{ ?k t:n_name ?x . NOT DATA {{ ?k t:far ?y }} }}
    RULE {{ ?k t:old true }} WHERE DATA {{ ?k t:far ?y }}"""
    return _terms(RuleSet(rules, PREFIXES).infer(QuadGraph(_quads(spark, d, "n_regionkey", "n_name")), delta=True))


@_register("srl_imports_goal", f"SELECT {iri('region', 'r_regionkey')} AS s, '{T}near' AS p, {NATION} AS o FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_regionkey = 2")
def _srl_goal(spark, d):
    rules = RuleSet("IMPORTS <urn:more> RULE { ?a t:unused ?b } WHERE { ?a t:n_name ?b }", PREFIXES, loader=lambda iri: "RULE { ?r t:near ?k } WHERE { ?k t:n_regionkey ?r }")
    return _terms(rules.goal(QuadGraph(_quads(spark, d, "n_regionkey", "n_name")), IRI(T + "region/2"), IRI(T + "near")))


@_register("srl_blank_heads", "SELECT count(*) AS n, count(*) AS nodes FROM nation")
def _srl_blank(spark, d):
    made = RuleSet("RULE { _:b t:about ?k } WHERE { ?k t:n_name ?x }", PREFIXES).infer(QuadGraph(_quads(spark, d, "n_name")), delta=True)
    return made.agg(F.count("*").alias("n"), F.count_distinct("s").alias("nodes"))


@_register("shacl_rule_layers", f"SELECT {iri('nation', 'n_nationkey')} AS s, '{T}first' AS p, 'true' AS o FROM nation UNION ALL SELECT {iri('nation', 'n_nationkey')}, '{T}second', 'true' FROM nation")
def _rule_layers(spark, d):
    """The rule of the first layer runs before what it would look for is made; the one that runs once sees only the base."""
    rules = """t:R sh:targetSubjectsOf t:n_name ; sh:rule
      [ a sh:SPARQLRule ; sh:layer 1 ; sh:construct "CONSTRUCT { $this t:second true } WHERE { $this t:first true }" ] ,
      [ a sh:SPARQLRule ; sh:layer 0 ; sh:order 0 ; sh:construct "CONSTRUCT { $this t:early true } WHERE { $this t:second true }" ] ,
      [ a sh:SPARQLRule ; sh:layer 0 ; sh:order 1 ; sh:runOnce true ; sh:construct "CONSTRUCT { $this t:once true } WHERE { $this t:first true }" ] ,
      [ a sh:SPARQLRule ; sh:layer 0 ; sh:order 2 ; sh:construct "CONSTRUCT { $this t:first true } WHERE { $this t:n_name ?n }" ] ."""
    return _terms(apply_rules(QuadGraph(_quads(spark, d, "n_name")), rules, PREFIXES))


@_register("rdf_regime", f"SELECT '{T}n_name' AS s, '{RDF}type' AS p, '{RDF}Property' AS o UNION ALL SELECT '{T}n_regionkey', '{RDF}type', '{RDF}Property'")
def _rdf_regime(spark, d):
    closed = entailment.rdf_closure(_quads(spark, d, "n_regionkey", "n_name"))
    return _terms(closed.where((F.col("p") == RDF + "type") & F.col("s")["v"].startswith(T)))


__all__ = ["QUERIES"]

"""The registered graph queries over the test tables, with the same results in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.functions.terms import box, lexical
from quadloom.operators import entailment, profile, setops, shacl
from quadloom.operators.node_expressions import values_of
from quadloom.operators.rules import RuleSet
from quadloom.operators.shacl_rules import apply_rules
from quadloom.plans.catalog import PREFIXES, T, testdata
from quadloom.plans.durable import durable
from quadloom.plans.engine import Engine
from quadloom.sources import ntriples
from quadloom.sources.graphs import QuadGraph
from quadloom.sparql.ast import IRI, Triple, Var


@dataclass(frozen=True)
class Registered:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(testdata(spark, sf_dir), PREFIXES)


def _sparql(text: str, sql: str) -> Registered:
    return Registered(lambda spark, d: engine(spark, d).select(text, lexical_forms=True), sql)


def iri(name: str, key: str) -> str:
    """SQL for the IRI of a row."""
    return f"concat('{T}{name}/', {key})"


def quads_of(e: Engine, patterns: list[tuple[str, str]]) -> DataFrame:
    """Mapped triples of (subject class pattern, predicate) as a table of quads."""
    out = None
    for predicate, _ in patterns:
        s = e.graph.scan([Triple(Var("s"), IRI(T + predicate), Var("o"))])
        df = s.df.select(F.lit("").alias("g"), box(s.value("s")).alias("s"), F.lit(T + predicate).alias("p"), box(s.value("o")).alias("o"))
        out = df if out is None else out.unionByName(df)
    return out


CENTS = "SUM(xsd:integer(FLOOR(?{} * 100 + 0.5)))"


def cents(c: str) -> str:
    return f"CAST(sum(CAST(floor({c} * 100 + 0.5) AS BIGINT)) AS BIGINT)"


QUERIES: dict[str, Registered] = {
    "nation_balances": _sparql(
        f"SELECT ?n ({CENTS.format('b')} AS ?bal) WHERE {{ ?c t:c_nationkey ?k ; t:c_acctbal ?b . ?k t:n_name ?n . FILTER(?b > 0) }} GROUP BY ?n ORDER BY DESC(?bal) ?n LIMIT 10",
        f"SELECT n_name AS n, {cents('c_acctbal')} AS bal FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY 1 ORDER BY bal DESC, n LIMIT 10",
    ),
    "bgp_star": _sparql(
        "SELECT ?c ?name ?seg WHERE { ?c t:c_name ?name ; t:c_mktsegment ?seg ; t:c_nationkey <https://example.org/t/nation/3> }",
        f"SELECT {iri('customer', 'c_custkey')} AS c, c_name AS name, c_mktsegment AS seg FROM customer WHERE c_nationkey = 3",
    ),
    "bgp_chain": _sparql(
        "SELECT ?r (COUNT(*) AS ?n) WHERE { ?l t:l_orderkey ?o . ?o t:o_custkey ?c . ?c t:c_nationkey ?k . ?k t:n_regionkey ?g . ?g t:r_name ?r } GROUP BY ?r",
        "SELECT r_name AS r, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    ),
    "bgp_cycle": _sparql(
        "SELECT ?k (COUNT(*) AS ?n) WHERE { ?l t:l_orderkey ?o ; t:l_suppkey ?s . ?o t:o_custkey ?c . ?c t:c_nationkey ?k . ?s t:s_nationkey ?k } GROUP BY ?k",
        f"SELECT {iri('nation', 'c_nationkey')} AS k, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey GROUP BY 1",
    ),
    "variable_predicate": _sparql(
        "SELECT ?p (COUNT(*) AS ?n) WHERE { ?s ?p ?o . ?s a t:Nation } GROUP BY ?p",
        f"SELECT p, count(*) AS n FROM (SELECT unnest(['{T}n_name', '{T}n_regionkey', 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type']) AS p FROM nation) GROUP BY 1",
    ),
    "filter_compare": _sparql(
        "SELECT ?p ?size WHERE { ?p t:p_size ?size ; t:p_retailprice ?price . FILTER(?size >= 20 && ?size < 25 && ?price > 950.5) }",
        f"SELECT {iri('part', 'p_partkey')} AS p, CAST(p_size AS BIGINT) AS size FROM part WHERE p_size >= 20 AND p_size < 25 AND p_retailprice > 950.5",
    ),
    "filter_in": _sparql(
        "SELECT ?o WHERE { ?o t:o_orderstatus ?s ; t:o_orderpriority ?p . FILTER(?s IN ('F', 'P') && ?p NOT IN ('5-LOW', '1-URGENT')) }",
        f"SELECT {iri('order', 'o_orderkey')} AS o FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority NOT IN ('5-LOW', '1-URGENT')",
    ),
    "filter_logic": _sparql(
        "SELECT ?p WHERE { ?p t:p_type ?t ; t:p_brand ?b ; t:p_size ?z . FILTER(!(?t = 'PROMO') && (?b = 'Brand#2' || ?z > 45)) }",
        f"SELECT {iri('part', 'p_partkey')} AS p FROM part WHERE NOT p_type = 'PROMO' AND (p_brand = 'Brand#2' OR p_size > 45)",
    ),
    "filter_regex": _sparql(
        "SELECT ?p ?n WHERE { ?p t:p_name ?n . FILTER(REGEX(?n, '^SM.*(ring|bolt)$', 'i')) }",
        f"SELECT {iri('part', 'p_partkey')} AS p, p_name AS n FROM part WHERE regexp_matches(p_name, '^SM.*(ring|bolt)$', 'i')",
    ),
    "optional_left": _sparql(
        "SELECT ?d ?t WHERE { ?d t:documents_source 'src3' OPTIONAL { ?d t:labels_toxic ?t } }",
        f"SELECT {iri('document', 'd.doc_id')} AS d, CAST(toxic AS BIGINT) AS t FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE source = 'src3'",
    ),
    "optional_filter": _sparql(
        "SELECT ?c (COUNT(?o) AS ?n) WHERE { ?c t:c_mktsegment 'BUILDING' OPTIONAL { ?o t:o_custkey ?c ; t:o_totalprice ?p FILTER(?p > 200000) } } GROUP BY ?c",
        f"SELECT {iri('customer', 'c_custkey')} AS c, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000 WHERE c_mktsegment = 'BUILDING' GROUP BY c_custkey",
    ),
    "optional_outer_filter": _sparql(
        "SELECT ?a ?s WHERE { ?a t:n_regionkey ?g ; t:n_name ?na OPTIONAL { ?s t:s_nationkey ?a ; t:s_name ?ns FILTER(STRLEN(?ns) > STRLEN(?na) + 9) } }",
        f"SELECT {iri('nation', 'n_nationkey')} AS a, CASE WHEN s_suppkey IS NOT NULL THEN {iri('supplier', 's_suppkey')} END AS s FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND length(s_name) > length(n_name) + 9",
    ),
    "union_bag": _sparql(
        "SELECT ?n ?k WHERE { { ?x t:c_nationkey ?k ; t:c_name ?n } UNION { ?x t:s_nationkey ?k ; t:s_name ?n } }",
        f"SELECT c_name AS n, {iri('nation', 'c_nationkey')} AS k FROM customer UNION ALL SELECT s_name, {iri('nation', 's_nationkey')} FROM supplier",
    ),
    "values_join": _sparql(
        "SELECT ?o ?label WHERE { VALUES (?s ?label) { ('F' 'finished') ('P' 'pending') } ?o t:o_orderstatus ?s ; t:o_totalprice ?p FILTER(?p < 5000) }",
        f"SELECT {iri('order', 'o_orderkey')} AS o, label FROM orders JOIN (VALUES ('F', 'finished'), ('P', 'pending')) v(s, label) ON o_orderstatus = s WHERE o_totalprice < 5000",
    ),
    "bind_expr": _sparql(
        "SELECT ?p ?double WHERE { ?p t:p_size ?z . BIND(?z * 2 + 1 AS ?double) FILTER(?double > 90) }",
        f"SELECT {iri('part', 'p_partkey')} AS p, CAST(p_size * 2 + 1 AS BIGINT) AS double FROM part WHERE p_size * 2 + 1 > 90",
    ),
    "subselect_topk": _sparql(
        "SELECT ?c ?name ?n WHERE { { SELECT ?c (COUNT(*) AS ?n) WHERE { ?o t:o_custkey ?c } GROUP BY ?c ORDER BY DESC(?n) ?c LIMIT 5 } ?c t:c_name ?name }",
        f"SELECT {iri('customer', 'k')} AS c, c_name AS name, n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, k LIMIT 5) JOIN customer ON c_custkey = k",
    ),
    "minus_set": _sparql(
        "SELECT ?c WHERE { ?c a t:Customer MINUS { ?o t:o_custkey ?c ; t:o_orderstatus 'P' } }",
        f"SELECT {iri('customer', 'c_custkey')} AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    ),
    "not_exists": _sparql(
        "SELECT ?p WHERE { ?p t:p_size 10 FILTER NOT EXISTS { ?l t:l_partkey ?p ; t:l_returnflag 'R' ; t:l_quantity 50.0e0 } }",
        f"SELECT {iri('part', 'p_partkey')} AS p FROM part WHERE p_size = 10 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity = 50)",
    ),
    "exists_theta": _sparql(
        "SELECT ?o WHERE { ?o t:o_custkey ?c ; t:o_totalprice ?p FILTER EXISTS { ?x t:o_custkey ?c ; t:o_totalprice ?q FILTER(?q > ?p * 4) } }",
        f"SELECT {iri('order', 'a.o_orderkey')} AS o FROM orders a WHERE EXISTS (SELECT 1 FROM orders b WHERE a.o_custkey = b.o_custkey AND b.o_totalprice > a.o_totalprice * 4)",
    ),
    "exists_in_or": _sparql(
        "SELECT ?c WHERE { ?c t:c_acctbal ?b FILTER(?b > 9000 || EXISTS { ?o t:o_custkey ?c ; t:o_totalprice ?p FILTER(?p > 300000) }) }",
        f"SELECT {iri('customer', 'c_custkey')} AS c FROM customer WHERE c_acctbal > 9000 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    ),
    "range_join": _sparql(
        "SELECT ?a ?b WHERE { ?a t:s_acctbal ?x . ?b t:s_acctbal ?y . FILTER(?y > ?x && ?y < ?x + 5) }",
        f"SELECT {iri('supplier', 'a.s_suppkey')} AS a, {iri('supplier', 'b.s_suppkey')} AS b FROM supplier a JOIN supplier b ON b.s_acctbal > a.s_acctbal AND b.s_acctbal < a.s_acctbal + 5",
    ),
    "agg_count_distinct": _sparql(
        "SELECT ?f (COUNT(*) AS ?n) (COUNT(DISTINCT ?p) AS ?parts) WHERE { ?l t:l_returnflag ?f ; t:l_partkey ?p } GROUP BY ?f",
        "SELECT l_returnflag AS f, count(*) AS n, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1",
    ),
    "agg_sum_avg": _sparql(
        f"SELECT ?f ?s (SUM(?q) AS ?qty) ({CENTS.format('x')} AS ?price) (AVG(?z) AS ?mean) WHERE {{ ?l t:l_returnflag ?f ; t:l_linestatus ?s ; t:l_quantity ?q ; t:l_extendedprice ?x ; t:l_linenumber ?z0 BIND(xsd:double(?z0) AS ?z) }} GROUP BY ?f ?s",
        f"SELECT l_returnflag AS f, l_linestatus AS s, sum(l_quantity) AS qty, {cents('l_extendedprice')} AS price, avg(CAST(l_linenumber AS DOUBLE)) AS mean FROM lineitem GROUP BY 1, 2",
    ),
    "agg_min_max": _sparql(
        "SELECT ?t (MIN(?p) AS ?low) (MAX(?p) AS ?high) (MIN(?n) AS ?first) WHERE { ?x t:p_type ?t ; t:p_retailprice ?p ; t:p_name ?n } GROUP BY ?t",
        "SELECT p_type AS t, min(p_retailprice) AS low, max(p_retailprice) AS high, min(p_name) AS first FROM part GROUP BY 1",
    ),
    "agg_group_concat": _sparql(
        "SELECT ?r (GROUP_CONCAT(?n ; SEPARATOR='|') AS ?names) WHERE { ?k t:n_regionkey ?g ; t:n_name ?n . ?g t:r_name ?r } GROUP BY ?r",
        "SELECT r_name AS r, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    ),
    "agg_sample": _sparql(
        "SELECT ?b (SAMPLE(?n) AS ?one) WHERE { ?p t:p_brand ?b ; t:p_name ?n } GROUP BY ?b",
        "SELECT p_brand AS b, min(p_name) AS one FROM part GROUP BY 1",
    ),
    "agg_having": _sparql(
        "SELECT ?c (COUNT(*) AS ?n) WHERE { ?o t:o_custkey ?c ; t:o_totalprice ?p } GROUP BY ?c HAVING (COUNT(*) > 9) (MAX(?p) < 450000)",
        f"SELECT {iri('customer', 'o_custkey')} AS c, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 9 AND max(o_totalprice) < 450000",
    ),
    "agg_implicit": _sparql(
        "SELECT (COUNT(*) AS ?n) (MIN(?p) AS ?low) WHERE { ?o t:o_totalprice ?p FILTER(?p < 0) }",
        "SELECT count(*) AS n, min(o_totalprice) AS low FROM orders WHERE o_totalprice < 0",
    ),
    "group_by_expr": _sparql(
        "SELECT ?y (COUNT(*) AS ?n) WHERE { ?o t:o_orderdate ?d } GROUP BY (YEAR(?d) AS ?y)",
        "SELECT CAST(year(o_orderdate) AS BIGINT) AS y, count(*) AS n FROM orders GROUP BY 1",
    ),
    "order_limit_offset": _sparql(
        "SELECT ?o ?p WHERE { ?o t:o_totalprice ?p } ORDER BY DESC(?p) ?o LIMIT 7 OFFSET 5",
        f"SELECT {iri('order', 'o_orderkey')} AS o, o_totalprice AS p FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 7 OFFSET 5",
    ),
    "distinct_rows": _sparql("SELECT DISTINCT ?b ?t WHERE { ?p t:p_brand ?b ; t:p_type ?t }", "SELECT DISTINCT p_brand AS b, p_type AS t FROM part"),
    "fn_string": _sparql(
        "SELECT ?p ?u ?s ?b ?a ?l ?c WHERE { ?p t:p_name ?n BIND(UCASE(?n) AS ?u) BIND(SUBSTR(?n, 2, 3) AS ?s) BIND(STRBEFORE(?n, ' ') AS ?b) BIND(STRAFTER(?n, ' ') AS ?a) BIND(STRLEN(?n) AS ?l) BIND(CONCAT(?b, '-', ?a) AS ?c) FILTER(CONTAINS(?n, 'in') && STRSTARTS(?n, 's') && !STRENDS(?n, 'x')) }",
        f"SELECT {iri('part', 'p_partkey')} AS p, upper(p_name) AS u, substr(p_name, 2, 3) AS s, split_part(p_name, ' ', 1) AS b, substr(p_name, instr(p_name, ' ') + 1) AS a, length(p_name) AS l, replace(p_name, ' ', '-') AS c FROM part WHERE contains(p_name, 'in') AND starts_with(p_name, 's') AND NOT ends_with(p_name, 'x')",
    ),
    "fn_math": _sparql(
        "SELECT ?c ?a ?f ?u ?r ?d WHERE { ?c t:c_acctbal ?b BIND(ABS(?b) AS ?a) BIND(FLOOR(?b) AS ?f) BIND(CEIL(?b) AS ?u) BIND(ROUND(?b) AS ?r) BIND(-?b / 4 AS ?d) }",
        f"SELECT {iri('customer', 'c_custkey')} AS c, abs(c_acctbal) AS a, floor(c_acctbal) AS f, ceil(c_acctbal) AS u, floor(c_acctbal + 0.5::DOUBLE) AS r, (0 - c_acctbal) / 4 AS d FROM customer",
    ),
    "fn_date": _sparql(
        "SELECT ?e ?y ?m ?d ?h ?n WHERE { ?e t:events_ts ?t ; t:events_event_type 'error' BIND(YEAR(?t) AS ?y) BIND(MONTH(?t) AS ?m) BIND(DAY(?t) AS ?d) BIND(HOURS(?t) AS ?h) BIND(MINUTES(?t) AS ?n) }",
        f"SELECT {iri('event', 'event_id')} AS e, CAST(year(ts) AS BIGINT) AS y, CAST(month(ts) AS BIGINT) AS m, CAST(day(ts) AS BIGINT) AS d, CAST(hour(ts) AS BIGINT) AS h, CAST(minute(ts) AS BIGINT) AS n FROM events WHERE event_type = 'error'",
    ),
    "filter_date": _sparql(
        "SELECT ?o WHERE { ?o t:o_orderdate ?d FILTER(?d >= '1997-03-01T00:00:00'^^xsd:dateTime && ?d < '1997-03-10T00:00:00'^^xsd:dateTime) }",
        f"SELECT {iri('order', 'o_orderkey')} AS o FROM orders WHERE o_orderdate >= TIMESTAMP '1997-03-01' AND o_orderdate < TIMESTAMP '1997-03-10'",
    ),
    "fn_hash": _sparql(
        "SELECT ?k ?m ?s ?t WHERE { ?k t:n_name ?n BIND(MD5(?n) AS ?m) BIND(SHA1(?n) AS ?s) BIND(SHA256(?n) AS ?t) }",
        f"SELECT {iri('nation', 'n_nationkey')} AS k, md5(n_name) AS m, sha1(n_name) AS s, sha256(n_name) AS t FROM nation",
    ),
    "fn_if_coalesce": _sparql(
        "SELECT ?d ?x ?y WHERE { ?d t:documents_n_chars ?n OPTIONAL { ?d t:labels_quality ?q } BIND(IF(?n > 2000, 'long', 'short') AS ?x) BIND(COALESCE(?q, -1) AS ?y) }",
        f"SELECT {iri('document', 'd.doc_id')} AS d, CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END AS x, CAST(coalesce(quality, -1) AS BIGINT) AS y FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    ),
    "fn_cast_values": _sparql(
        "SELECT ?p ?i ?s WHERE { ?p t:p_retailprice ?a ; t:p_size ?z BIND(xsd:integer(?a) AS ?i) BIND(xsd:string(?z) AS ?s) }",
        f"SELECT {iri('part', 'p_partkey')} AS p, CAST(trunc(p_retailprice) AS BIGINT) AS i, CAST(p_size AS VARCHAR) AS s FROM part",
    ),
    "fn_encode_uri": _sparql(
        "SELECT ?p ?u WHERE { ?p t:p_name ?n ; t:p_brand ?b BIND(ENCODE_FOR_URI(CONCAT(?n, ' ', ?b)) AS ?u) }",
        f"SELECT {iri('part', 'p_partkey')} AS p, replace(replace(concat(p_name, ' ', p_brand), ' ', '%20'), '#', '%23') AS u FROM part",
    ),
    "fn_regex_replace": _sparql(
        "SELECT ?p ?x WHERE { ?p t:p_brand ?b BIND(REPLACE(?b, '([A-Z])rand#(.)', '$2/$1') AS ?x) }",
        f"SELECT {iri('part', 'p_partkey')} AS p, regexp_replace(p_brand, '([A-Z])rand#(.)', '\\2/\\1') AS x FROM part",
    ),
    "lang_tags": _sparql(
        "SELECT ?l (COUNT(*) AS ?n) WHERE { ?d t:documents_text ?t BIND(LANG(?t) AS ?l) FILTER(LANGMATCHES(?l, '*') && ISLITERAL(?t)) } GROUP BY ?l",
        "SELECT lang AS l, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1",
    ),
    "str_datatype": _sparql(
        "SELECT ?k ?s ?d WHERE { ?k t:n_name ?n ; t:n_regionkey ?r BIND(STR(?r) AS ?s) BIND(STR(DATATYPE(?n)) AS ?d) }",
        f"SELECT {iri('nation', 'n_nationkey')} AS k, {iri('region', 'n_regionkey')} AS s, 'http://www.w3.org/2001/XMLSchema#string' AS d FROM nation",
    ),
    "path_seq": _sparql(
        "SELECT ?c ?r WHERE { ?c t:c_nationkey/t:n_regionkey/t:r_name ?r }",
        f"SELECT {iri('customer', 'c_custkey')} AS c, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    ),
    "path_inverse": _sparql(
        "SELECT ?r (COUNT(*) AS ?n) WHERE { ?g t:r_name ?r . ?g ^t:n_regionkey/^t:s_nationkey ?s } GROUP BY ?r",
        "SELECT r_name AS r, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    ),
    "path_alt": _sparql(
        "SELECT ?k (COUNT(*) AS ?n) WHERE { ?x (t:c_nationkey|t:s_nationkey) ?k } GROUP BY ?k",
        f"SELECT {iri('nation', 'k')} AS k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1",
    ),
    "path_plus": _sparql(
        "SELECT ?a (COUNT(*) AS ?n) WHERE { ?a t:conversations_before+ ?b } GROUP BY ?a",
        f"SELECT {iri('turn', 'a.conv_id, ' + repr('-') + ', a.turn')} AS a, count(*) AS n FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn < a.turn GROUP BY 1",
    ),
    "path_star_start": _sparql(
        "SELECT ?b WHERE { <https://example.org/t/turn/3-4> t:conversations_before* ?b }",
        f"SELECT '{T}turn/3-4' AS b UNION SELECT {iri('turn', 'conv_id, ' + repr('-') + ', turn')} FROM conversations WHERE conv_id = 3 AND turn < 4 AND EXISTS (SELECT 1 FROM conversations WHERE conv_id = 3 AND turn = 4)",
    ),
    "path_negated": _sparql(
        "SELECT ?o WHERE { <https://example.org/t/nation/3> !(t:n_name|<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>) ?o }",
        f"SELECT {iri('region', 'n_regionkey')} AS o FROM nation WHERE n_nationkey = 3",
    ),
    "graph_named": _sparql(
        "SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?o t:o_totalprice ?p FILTER(?p > 100000) } } GROUP BY ?g",
        f"SELECT {iri('status', 'o_orderstatus')} AS g, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1",
    ),
    "graph_constant": _sparql(
        "SELECT ?o WHERE { GRAPH <https://example.org/t/status/P> { ?o t:o_orderpriority '1-URGENT' } }",
        f"SELECT {iri('order', 'o_orderkey')} AS o FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'",
    ),
}


def _terms(df: DataFrame) -> DataFrame:
    """Quads with plain text columns."""
    return df.select(F.col("s")["v"].alias("s"), "p", F.col("o")["v"].alias("o"))


def _construct(spark: SparkSession, d: str) -> DataFrame:
    return _terms(engine(spark, d).construct("CONSTRUCT { ?k t:inRegion ?r ; t:label ?n } WHERE { ?k t:n_regionkey ?g ; t:n_name ?n . ?g t:r_name ?r }"))


QUERIES["construct_triples"] = Registered(_construct, f"SELECT {iri('nation', 'n_nationkey')} AS s, '{T}inRegion' AS p, r_name AS o FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT {iri('nation', 'n_nationkey')}, '{T}label', n_name FROM nation")


def _describe(spark: SparkSession, d: str) -> DataFrame:
    return _terms(engine(spark, d).construct("DESCRIBE <https://example.org/t/nation/7>"))


QUERIES["describe_cbd"] = Registered(_describe, f"SELECT {iri('nation', 'n_nationkey')} AS s, u.p AS p, u.o AS o FROM (SELECT *, unnest([{{'p': '{T}n_name', 'o': n_name}}, {{'p': '{T}n_regionkey', 'o': {iri('region', 'n_regionkey')}}}, {{'p': 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'o': '{T}Nation'}}]) AS u FROM nation WHERE n_nationkey = 7)")


def _ask(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(engine(spark, d).ask("ASK { ?o t:o_orderstatus 'F' }"),)], "answer boolean")


QUERIES["ask_true"] = Registered(_ask, "SELECT count(*) > 0 AS answer FROM orders WHERE o_orderstatus = 'F'")


def _set_query(operation: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        e = engine(spark, d)
        a = e.construct("CONSTRUCT { ?u t:did ?t } WHERE { ?e t:events_user_id ?u ; t:events_event_type ?t ; t:events_value ?v FILTER(?v < 60) }")
        b = e.construct("CONSTRUCT { ?u t:did ?t } WHERE { ?e t:events_user_id ?u ; t:events_event_type ?t ; t:events_value ?v FILTER(?v > 40) }")
        return _terms(operation(a, b))

    return run


_A = f"SELECT {iri('user', 'user_id')} AS s, '{T}did' AS p, event_type AS o FROM events WHERE value < 60"
_B = f"SELECT {iri('user', 'user_id')} AS s, '{T}did' AS p, event_type AS o FROM events WHERE value > 40"
QUERIES |= {
    "set_union": Registered(_set_query(setops.graph_union), f"{_A} UNION {_B}"),
    "set_intersect": Registered(_set_query(setops.graph_intersection), f"{_A} INTERSECT {_B}"),
    "set_difference": Registered(_set_query(setops.graph_difference), f"{_A} EXCEPT {_B}"),
    "set_symdiff": Registered(_set_query(setops.graph_symmetric_difference), f"(({_A}) EXCEPT ({_B})) UNION (({_B}) EXCEPT ({_A}))"),
}


def _update(spark: SparkSession, d: str) -> DataFrame:
    quads = quads_of(engine(spark, d), [("o_orderstatus", "")]).distinct()
    after = Engine(QuadGraph(quads), PREFIXES).update("DELETE { ?o t:o_orderstatus 'P' } INSERT { ?o t:o_orderstatus 'PENDING' } WHERE { ?o t:o_orderstatus 'P' }")
    return _terms(after.quads)


QUERIES["update_delete_insert"] = Registered(_update, f"SELECT {iri('order', 'o_orderkey')} AS s, '{T}o_orderstatus' AS p, CASE o_orderstatus WHEN 'P' THEN 'PENDING' ELSE o_orderstatus END AS o FROM orders")


def _quad_join(spark: SparkSession, d: str) -> DataFrame:
    """The same join over boxed quads as over mapped tables."""
    quads = durable(quads_of(engine(spark, d), [("c_nationkey", ""), ("n_name", ""), ("c_acctbal", "")]), "quads")
    return Engine(QuadGraph(quads), PREFIXES).select("SELECT ?n (COUNT(*) AS ?cnt) WHERE { ?c t:c_nationkey ?k ; t:c_acctbal ?b . ?k t:n_name ?n FILTER(?b >= 5000) } GROUP BY ?n", lexical_forms=True)


QUERIES["quads_join_filter"] = Registered(_quad_join, "SELECT n_name AS n, count(*) AS cnt FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal >= 5000 GROUP BY 1")


def _reified(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d)
    quads = e.construct("CONSTRUCT { ?d t:has ?s . ?r rdf:reifies <<( ?d t:has ?s )>> ; t:quality ?q } WHERE { ?d t:documents_source ?s ; t:labels_quality ?q BIND(IRI(CONCAT(STR(?d), '/note')) AS ?r) }")
    return Engine(QuadGraph(durable(quads, "reified")), PREFIXES).select("SELECT ?d ?s ?q WHERE { << ?d t:has ?s >> t:quality ?q }", lexical_forms=True)


QUERIES["triple_term_match"] = Registered(_reified, f"SELECT {iri('document', 'd.doc_id')} AS d, source AS s, CAST(quality AS VARCHAR) AS q FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NOT NULL AND source IS NOT NULL")


def _annotations(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d)
    quads = e.construct("CONSTRUCT { ?r rdf:reifies <<( ?d t:has ?s )>> ; t:toxic ?q } WHERE { ?d t:documents_source ?s ; t:labels_toxic ?q BIND(IRI(CONCAT(STR(?d), '/note')) AS ?r) }")
    out = setops.reifier_annotations(durable(quads, "notes"))
    return out.select(F.col("s")["v"].alias("s"), F.col("o")["v"].alias("o"), "ap", F.col("ao")["v"].alias("ao"))


QUERIES["reify_annotations"] = Registered(_annotations, f"SELECT {iri('document', 'd.doc_id')} AS s, source AS o, '{T}toxic' AS ap, CAST(toxic AS VARCHAR) AS ao FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE toxic IS NOT NULL AND source IS NOT NULL")


def _typed_parts(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d)
    data = e.construct("CONSTRUCT { ?p rdf:type ?c ; t:made ?b } WHERE { ?p t:p_type ?t ; t:p_brand ?b BIND(IRI(CONCAT('https://example.org/t/kind/', ?t)) AS ?c) }")
    schema = e.construct(
        "CONSTRUCT { ?c rdfs:subClassOf t:Goods . t:Goods rdfs:subClassOf t:Thing . t:made rdfs:domain t:Product ; rdfs:subPropertyOf t:related } WHERE { ?p t:p_type ?t BIND(IRI(CONCAT('https://example.org/t/kind/', ?t)) AS ?c) }"
    )
    return data.unionByName(schema)


def _rdfs(spark: SparkSession, d: str) -> DataFrame:
    closed = entailment.rdfs_closure(durable(_typed_parts(spark, d), "typed"))
    return closed.where("s.v like 'https://example.org/t/part/%'").groupBy("p", F.when(F.col("o")["k"] == 2, F.col("o")["v"]).otherwise("").alias("c")).agg(F.count("*").alias("n"))


QUERIES["rdfs_closure"] = Registered(
    _rdfs,
    f"""WITH a AS (SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS p, unnest([concat('{T}kind/', p_type), '{T}Goods', '{T}Thing', '{T}Product']) AS c FROM part
    UNION ALL SELECT unnest(['{T}made', '{T}related']), '' FROM part) SELECT p, c, count(*) AS n FROM a GROUP BY 1, 2""",
)

SHAPES = """
t:CustomerShape a sh:NodeShape ; sh:targetClass t:Customer ;
  sh:property [ sh:path t:c_acctbal ; sh:minInclusive 0 ; sh:datatype xsd:double ; sh:minCount 1 ; sh:maxCount 1 ] ;
  sh:property [ sh:path t:c_mktsegment ; sh:in ("BUILDING" "MACHINERY" "HOUSEHOLD") ; sh:pattern "^[A-Z]+$" ] ;
  sh:property [ sh:path ( t:c_nationkey t:n_regionkey ) ; sh:class t:Region ; sh:hasValue <https://example.org/t/region/1> ] ;
  sh:property [ sh:path [ sh:inversePath t:o_custkey ] ; sh:minCount 3 ; sh:maxCount 16 ] .
t:PartShape a sh:NodeShape ; sh:targetClass t:Part ;
  sh:property [ sh:path t:p_name ; sh:maxLength 12 ; sh:minLength 9 ] ;
  sh:property [ sh:path t:p_size ; sh:or ( [ sh:maxExclusive 5 ] [ sh:minExclusive 40 ] ) ] ;
  sh:property [ sh:path t:p_brand ; sh:not [ sh:hasValue "Brand#2" ] ] .
"""


def _shacl(spark: SparkSession, d: str) -> DataFrame:
    found = shacl.validate(engine(spark, d), SHAPES)
    return found.groupBy(F.regexp_replace("component", ".*#", "").alias("component")).agg(F.count("*").alias("n"))


QUERIES["shacl_core"] = Registered(
    _shacl,
    """SELECT * FROM (SELECT 'MinInclusiveConstraintComponent' AS component, count(*) AS n FROM customer WHERE c_acctbal < 0
    UNION ALL SELECT 'InConstraintComponent', count(*) FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')
    UNION ALL SELECT 'HasValueConstraintComponent', count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 1
    UNION ALL SELECT 'MinCountConstraintComponent', count(*) FROM customer WHERE (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) < 3
    UNION ALL SELECT 'MaxCountConstraintComponent', count(*) FROM customer WHERE (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) > 16
    UNION ALL SELECT 'MaxLengthConstraintComponent', count(*) FROM part WHERE length(p_name) > 12
    UNION ALL SELECT 'MinLengthConstraintComponent', count(*) FROM part WHERE length(p_name) < 9
    UNION ALL SELECT 'OrConstraintComponent', count(*) FROM part WHERE NOT (p_size < 5 OR p_size > 40)
    UNION ALL SELECT 'NotConstraintComponent', count(*) FROM part WHERE p_brand = 'Brand#2') WHERE n > 0""",
)

RULES = """
RULE { ?a t:reaches ?b } WHERE { ?a t:conversations_before ?b }
RULE { ?a t:reaches ?c } WHERE { ?a t:reaches ?b . ?b t:conversations_before ?c }
RULE { ?a a t:Last } WHERE { ?a t:conversations_before ?b . NOT { ?x t:conversations_before ?a } }
"""


def _rules(spark: SparkSession, d: str) -> DataFrame:
    quads = durable(quads_of(engine(spark, d), [("conversations_before", "")]), "turns")
    made = RuleSet(RULES, PREFIXES).infer(QuadGraph(quads), delta=True)
    return made.groupBy("p").agg(F.count("*").alias("n"))


QUERIES["srl_recursion_negation"] = Registered(
    _rules,
    f"""SELECT '{T}reaches' AS p, count(*) AS n FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn < a.turn
    UNION ALL SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', count(*) FROM (SELECT conv_id, max(turn) AS m FROM conversations GROUP BY 1) WHERE m > 0""",
)

QUERIES["path_in_graph"] = _sparql(
    "SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?o t:o_custkey/^t:o_custkey ?p } } GROUP BY ?g",
    f"SELECT {iri('status', 'a.o_orderstatus')} AS g, count(*) AS n FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderstatus = b.o_orderstatus GROUP BY 1",
)
QUERIES["exists_correlated"] = _sparql(
    "SELECT ?c WHERE { ?c t:c_nationkey ?k ; t:c_acctbal ?b FILTER(?b > 9000 || EXISTS { ?s t:s_nationkey ?k ; t:s_acctbal ?v FILTER(?v < ?b - 8000) }) }",
    f"SELECT {iri('customer', 'c_custkey')} AS c FROM customer WHERE c_acctbal > 9000 OR EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal < c_acctbal - 8000)",
)


def _query_time(spark: SparkSession, d: str) -> DataFrame:
    """The RDFS answer to one pattern without the closure."""
    triples = durable(_typed_parts(spark, d), "typed")
    e = Engine(QuadGraph(triples.distinct()), PREFIXES, entailment="RDFS")
    return e.select("SELECT DISTINCT ?p WHERE { ?p a t:Thing }", lexical_forms=True)


QUERIES["rdfs_query_time"] = Registered(_query_time, f"SELECT {iri('part', 'p_partkey')} AS p FROM part")


def _owl(spark: SparkSession, d: str) -> DataFrame:
    data = engine(spark, d).construct("CONSTRUCT { ?k t:in ?g . ?g t:in t:World . t:in a owl:TransitiveProperty ; owl:inverseOf t:holds } WHERE { ?k t:n_regionkey ?g }")
    closed = entailment.owl_rl_closure(durable(data, "owl-data"))
    return _terms(closed.where(F.col("p").isin(T + "in", T + "holds")))


_IN = f"SELECT {iri('nation', 'n_nationkey')} AS a, {iri('region', 'n_regionkey')} AS b FROM nation UNION SELECT {iri('region', 'n_regionkey')}, '{T}World' FROM nation UNION SELECT {iri('nation', 'n_nationkey')}, '{T}World' FROM nation"
QUERIES["owl_rl_closure"] = Registered(_owl, f"WITH i AS ({_IN}) SELECT a AS s, '{T}in' AS p, b AS o FROM i UNION ALL SELECT b, '{T}holds', a FROM i")


def _profile(spark: SparkSession, d: str) -> DataFrame:
    data = engine(spark, d).construct("CONSTRUCT { ?c a t:Customer . ?c t:ordered ?o ; t:segment ?s } WHERE { ?c t:c_mktsegment ?s OPTIONAL { ?o t:o_custkey ?c } }")
    return profile.derive_shapes(durable(data, "profile")).select("p", "members", "have", F.col("least").cast("bigint").alias("least"), "most")


QUERIES["derive_shapes"] = Registered(
    _profile,
    f"""WITH n AS (SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer)
    SELECT '{T}ordered' AS p, count(*) AS members, count(*) FILTER (n > 0) AS have, min(n) AS least, max(n) AS most FROM n
    UNION ALL SELECT '{T}segment', count(*), count(*), 1, 1 FROM customer""",
)


def _provenance(spark: SparkSession, d: str) -> DataFrame:
    quads = durable(quads_of(engine(spark, d), [("c_nationkey", ""), ("n_name", ""), ("n_regionkey", "")]), "quads")
    e = Engine(QuadGraph(quads), PREFIXES)
    return _terms(profile.relevant_subgraph(e, "SELECT ?c WHERE { ?c t:c_nationkey ?k . ?k t:n_regionkey <https://example.org/t/region/2> }"))


QUERIES["relevant_subgraph"] = Registered(
    _provenance,
    f"""SELECT DISTINCT unnest([{iri('customer', 'c_custkey')}, {iri('nation', 'n_nationkey')}]) AS s, unnest(['{T}c_nationkey', '{T}n_regionkey']) AS p, unnest([{iri('nation', 'n_nationkey')}, {iri('region', 'n_regionkey')}]) AS o
    FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2""",
)


def _basic(spark: SparkSession, d: str) -> DataFrame:
    """Triple terms encoded and decoded again."""
    quads = durable(engine(spark, d).construct("CONSTRUCT { ?r rdf:reifies <<( ?k t:n_name ?n )>> } WHERE { ?k t:n_name ?n BIND(IRI(CONCAT(STR(?k), '/note')) AS ?r) }"), "terms")
    told = durable(setops.to_basic(quads), "basic")
    back = setops.from_basic(told)
    count = lambda df, kind: df.groupBy("p").agg(F.count("*").alias("n")).select(F.lit(kind).alias("side"), "p", "n")
    return count(told, "basic").unionByName(count(back.intersect(quads.select(back.columns)), "back"))


_RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
QUERIES["basic_encoding"] = Registered(
    _basic,
    f"""SELECT 'basic' AS side, p, count(*) AS n FROM (SELECT unnest(['{_RDF}reifies', '{_RDF}type', '{_RDF}propositionFormSubject', '{_RDF}propositionFormPredicate', '{_RDF}propositionFormObject']) AS p FROM nation) GROUP BY 2
    UNION ALL SELECT 'back', '{_RDF}reifies', count(*) FROM nation""",
)


def _round_trip(spark: SparkSession, d: str) -> DataFrame:
    """N-Quads written to lines and read again."""
    quads = quads_of(engine(spark, d), [("benchmark_text", "")])
    return _terms(ntriples.nquads_rows(durable(ntriples.lines(quads), "lines")))


QUERIES["nquads_round_trip"] = Registered(_round_trip, f"SELECT {iri('item', 'item_id')} AS s, '{T}benchmark_text' AS p, text AS o FROM benchmark")


def _copied(spark: SparkSession, d: str) -> DataFrame:
    quads = quads_of(engine(spark, d), [("r_name", ""), ("n_regionkey", "")]).distinct()
    e = Engine(QuadGraph(quads), PREFIXES).update("COPY DEFAULT TO t:copy ; DELETE WHERE { ?r t:r_name ?n } ; INSERT { GRAPH t:sizes { ?r t:nations ?k } } WHERE { SELECT ?r (COUNT(*) AS ?k) { ?n t:n_regionkey ?r } GROUP BY ?r }")
    return e.quads.groupBy("g", "p").agg(F.count("*").alias("n"))


QUERIES["update_copy_insert"] = Registered(
    _copied,
    f"""SELECT '' AS g, '{T}n_regionkey' AS p, count(*) AS n FROM nation UNION ALL SELECT '{T}copy', '{T}n_regionkey', count(*) FROM nation
    UNION ALL SELECT '{T}copy', '{T}r_name', count(*) FROM region UNION ALL SELECT '{T}sizes', '{T}nations', count(DISTINCT n_regionkey) FROM nation""",
)


def _expression(spark: SparkSession, d: str) -> DataFrame:
    """A node expression for every customer at once."""
    e = engine(spark, d)
    v = shacl.Validator(e, shacl.Shapes("t:holder t:is [ x:count [ x:filterShape [ sh:property [ sh:path t:o_totalprice ; sh:minExclusive 200000 ] ] ; x:nodes [ x:pathValues [ sh:inversePath t:o_custkey ] ] ] ] .", PREFIXES | {"x": "http://www.w3.org/ns/shacl-node-expr#"}))
    found = values_of(v, v.shapes.facts[IRI(T + "holder")][T + "is"][0], v.instances(IRI(T + "Customer")))
    return found.select(F.col("focus")["v"].alias("c"), F.col("node")["v"].alias("n"))


QUERIES["node_expression_count"] = Registered(_expression, f"SELECT {iri('customer', 'c_custkey')} AS c, CAST((SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) AS VARCHAR) AS n FROM customer")


def _shacl_rules(spark: SparkSession, d: str) -> DataFrame:
    quads = durable(quads_of(engine(spark, d), [("n_regionkey", ""), ("c_nationkey", "")]), "rules")
    rules = """
    t:R sh:targetSubjectsOf t:c_nationkey ; sh:rule [ a sh:TripleRule ; sh:subject sh:this ; sh:predicate t:inRegion ; sh:object [ x:pathValues ( t:c_nationkey t:n_regionkey ) ] ] ,
      [ a sh:SPARQLRule ; sh:order 1 ; sh:construct "CONSTRUCT { ?g t:has $this } WHERE { $this t:inRegion ?g }" ] .
    """
    return _terms(apply_rules(QuadGraph(quads), rules, PREFIXES | {"x": "http://www.w3.org/ns/shacl-node-expr#"}))


QUERIES["shacl_rules"] = Registered(
    _shacl_rules,
    f"""WITH r AS (SELECT {iri('customer', 'c_custkey')} AS c, {iri('region', 'n_regionkey')} AS g FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT c AS s, '{T}inRegion' AS p, g AS o FROM r UNION ALL SELECT g, '{T}has', c FROM r""",
)

COMPONENTS = """
t:Below sh:parameter [ sh:path t:below ] ; sh:validator [ sh:ask 'ASK { FILTER($value < $below) }' ] .
t:OrderShape sh:targetClass t:Order ; sh:property [ sh:path t:o_totalprice ; t:below 300000 ; sh:message "too dear" ] ;
  sh:property [ sh:path ( t:o_custkey t:c_acctbal ) ; sh:sparql [ sh:select 'SELECT $this ?value WHERE { $this $PATH ?value FILTER(?value < -500) }' ] ] .
"""


def _report(spark: SparkSession, d: str) -> DataFrame:
    """A report graph of a declared component and an embedded query, read by a query."""
    report = durable(shacl.report_graph(engine(spark, d), COMPONENTS), "report")
    return Engine(QuadGraph(report), PREFIXES).select("SELECT ?c (COUNT(?f) AS ?n) (COUNT(?m) AS ?told) WHERE { ?r sh:focusNode ?f ; sh:sourceConstraintComponent ?c OPTIONAL { ?r sh:resultMessage ?m } } GROUP BY ?c", lexical_forms=True)


QUERIES["shacl_report"] = Registered(
    _report,
    f"""SELECT * FROM (SELECT '{T}Below' AS c, count(*) AS n, count(*) AS told FROM orders WHERE o_totalprice >= 300000
    UNION ALL SELECT 'http://www.w3.org/ns/shacl#SPARQLConstraintComponent', count(*), 0 FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < -500) WHERE n > 0""",
)

__all__ = ["QUERIES", "engine", "lexical"]

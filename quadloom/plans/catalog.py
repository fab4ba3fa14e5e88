"""The relational test tables as a virtual graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.sources.graphs import Mapped, MappedGraph, TableMap

T = "https://example.org/t/"
PREFIXES = {
    "t": T,
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
    "owl": "http://www.w3.org/2002/07/owl#",
    "sh": "http://www.w3.org/ns/shacl#",
}


#: Tables whose columns carry a prefix of their own.
PREFIXED = {"region", "nation", "customer", "supplier", "part", "orders", "lineitem"}


def _map(table: str, name: str, key: str, columns: str, refers: dict[str, str] | None = None, prefix: str = "", language: dict[str, str] | None = None, typed: bool = True, **more) -> TableMap:
    """Predicates are t:column, or t:table_column where the column has no prefix of its own."""
    made = [Mapped(T + (c if table in PREFIXED else f"{table}_{c}"), c, T + refers[c] + "/" if refers and c in refers else None, (language or {}).get(c)) for c in columns.split()]
    return TableMap(table, T + name + "/", key, made, T + name.capitalize() if typed else None, **more)


MAPS = [
    _map("region", "region", "r_regionkey", "r_name"),
    _map("nation", "nation", "n_nationkey", "n_name n_regionkey", {"n_regionkey": "region"}),
    _map("customer", "customer", "c_custkey", "c_name c_nationkey c_acctbal c_mktsegment", {"c_nationkey": "nation"}),
    _map("supplier", "supplier", "s_suppkey", "s_name s_nationkey s_acctbal", {"s_nationkey": "nation"}),
    _map("part", "part", "p_partkey", "p_name p_brand p_type p_size p_retailprice"),
    _map("orders", "order", "o_orderkey", "o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority", {"o_custkey": "customer"}, graph="https://example.org/t/status/", graph_column="o_orderstatus"),
    _map("lineitem", "line", "concat(l_orderkey, '-', l_linenumber)", "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate", {"l_orderkey": "order", "l_partkey": "part", "l_suppkey": "supplier"}),
    _map("events", "event", "event_id", "ts user_id event_type value props", {"user_id": "user"}),
    _map("documents", "document", "doc_id", "text lang source n_chars", language={"text": "lang"}, graph="https://example.org/t/source/", graph_column="source"),
    _map("labels", "document", "doc_id", "quality toxic", typed=False),
    _map("conversations", "turn", "concat(conv_id, '-', turn)", "conv_id turn role text before", {"before": "turn"}),
    _map("pages", "page", "page_id", "url html"),
    _map("benchmark", "item", "item_id", "text"),
]


def testdata(spark: SparkSession, sf_dir: str) -> MappedGraph:
    def load(name: str) -> DataFrame:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        if name == "conversations":
            first = F.col("turn") > 0
            return df.withColumn("before", F.when(first, F.concat(F.col("conv_id"), F.lit("-"), F.col("turn") - 1)))
        return df

    return MappedGraph(spark, load, MAPS)

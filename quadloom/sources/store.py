"""A graph on disk: Parquet in buckets of predicates, so that a pattern with a fixed predicate reads its bucket alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.plans.solution import Solution
from quadloom.sources.graphs import QUADS, QuadGraph
from quadloom.sparql.ast import IRI, Triple

COLUMNS = ["g", "s", "p", "o"]
BUCKETS = 64


def bucket(p: Column) -> Column:
    return F.pmod(F.xxhash64(p), F.lit(BUCKETS)).cast("int")


class StoredGraph(QuadGraph):
    """A QuadGraph over a store; what it scans for a fixed predicate is one partition of the files."""

    def scan(self, triples: list[Triple], graph=None) -> Solution:
        (t,) = triples
        if not isinstance(t.p, IRI):
            return super().scan(triples, graph)
        mine = self.quads.where((F.col("bucket") == bucket(F.lit(t.p.v))) & (F.col("p") == t.p.v))
        return QuadGraph(mine.select(COLUMNS), self.default_union, self.default, self.named).scan(triples, graph)

    def dataset(self, default: list[str], named: list[str]) -> StoredGraph:
        return StoredGraph(self.quads, False, default, named) if default or named else self


class Store:
    """path: a folder that all executors reach. Additions append to it; a removal writes the buckets that it touches anew,
    beside the old ones, and then the folder's pointer to the version that counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        folder, fs = self.spark._jvm.org.apache.hadoop.fs.Path(self.path), self._fs()
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        # a version counts once its files are whole
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS")))

    def _write(self, quads: DataFrame, path: str, mode: str = "errorifexists") -> None:
        rows = quads.select(*COLUMNS, bucket(F.col("p")).alias("bucket"))
        # a predicate of very many triples is dealt out by its subjects too
        rows.repartition("bucket", F.pmod(F.xxhash64("s"), F.lit(16))).sortWithinPartitions("p", "s").write.mode(mode).partitionBy("bucket").parquet(path)

    def quads(self) -> DataFrame:
        """(g, s, p, o, bucket) of the version that counts."""
        versions = self._versions()
        schema = f"{QUADS}, bucket int"
        if not versions:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/v{versions[-1]}")

    def graph(self, default_union: bool = False) -> StoredGraph:
        return StoredGraph(self.quads(), default_union)

    def add(self, quads: DataFrame) -> None:
        """Only quads that are not there yet are written."""
        versions, new = self._versions(), quads.select(COLUMNS).distinct()
        if not versions:
            self._write(new, f"{self.path}/v1")
        else:
            old = self.quads()
            fresh = new.withColumn("bucket", bucket(F.col("p"))).join(old, ["bucket", *COLUMNS], "left_anti")
            self._write(fresh, f"{self.path}/v{versions[-1]}", "append")

    def remove(self, quads: DataFrame) -> None:
        """A new version without the quads; the one before goes when it is whole."""
        versions = self._versions()
        if not versions:
            return
        left = self.quads().join(quads.select(COLUMNS).withColumn("bucket", bucket(F.col("p"))), ["bucket", *COLUMNS], "left_anti")
        self._write(left, f"{self.path}/v{versions[-1] + 1}")
        self._fs().delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{versions[-1]}"), True)

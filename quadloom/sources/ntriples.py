"""N-Triples and N-Quads as DataFrames: each line is read and written by itself, so files split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.functions.terms import nt_text, parse_nt

IRI_OR_BLANK = r"<[^>\s]*>|_:[^\s]+"
LITERAL = r'"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?'
TRIPLE_TERM = r"<<\(.*\)>>"
LINE = rf"^\s*({IRI_OR_BLANK})\s+(<[^>\s]*>)\s+({TRIPLE_TERM}|{IRI_OR_BLANK}|{LITERAL})(?:\s+({IRI_OR_BLANK}))?\s*\.\s*(?:#.*)?$"


def nquads_rows(lines: DataFrame) -> DataFrame:
    """Quads of the lines in the column value; blank lines, comments and VERSION lines are passed over, others raise."""
    text = lines.where(~F.col("value").rlike(r"^\s*(?:#.*|VERSION\s.*)?$"))
    part = lambda i: F.regexp_extract("value", LINE, i)
    checked = text.select(F.when(F.col("value").rlike(LINE), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not N-Quads: "), F.col("value")))).alias("value"))
    graph = F.regexp_replace(part(4), "^<|>$", "")
    return checked.select(graph.alias("g"), parse_nt(part(1)).alias("s"), F.regexp_replace(part(2), "^<|>$", "").alias("p"), parse_nt(part(3)).alias("o"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The set of quads in a file or folder."""
    return nquads_rows(spark.read.text(path)).distinct()


def lines(quads: DataFrame) -> DataFrame:
    graph = F.when(F.col("g").startswith("_:"), F.concat(F.lit(" "), F.col("g"))).when(F.col("g") != "", F.concat(F.lit(" <"), F.col("g"), F.lit(">"))).otherwise("")
    return quads.select(F.concat(nt_text(F.col("s")), F.lit(" <"), F.col("p"), F.lit("> "), nt_text(F.col("o")), graph, F.lit(" .")).alias("value"))


def write(quads: DataFrame, path: str) -> None:
    lines(quads).write.text(path)

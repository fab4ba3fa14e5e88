"""Tables that cut lineage in loops; they lie in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame


@cache
def _own() -> str:
    return "file://" + tempfile.mkdtemp(prefix="quadloom-")


def durable(df: DataFrame, name: str = "step") -> DataFrame:
    """df, written to spark.checkpoint.dir and read again; a temporary folder only where that is unset and all runs on this machine."""
    spark = df.sparkSession
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not told and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{(told or _own()).rstrip('/')}/quadloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quadloom_path = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes the table of a durable() that nothing reads any more."""
    path, spark = getattr(df, "_quadloom_path", None), df.sparkSession
    if path:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

"""What the operators share: durable intermediate tables, Arrow row mapping, stable holdout folds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="quadloom-")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); where it is unset, a temporary one if all runs on this machine, else an error."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not told and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (told or "file://" + _own_folder()).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/quadloom/{name}-{uuid.uuid4().hex}"


def mounted(path: str) -> str:
    """The path under which executors open a shared file themselves; the shared folder must be mounted for that."""
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"{path}: memory-mapped levels need a mounted shared folder in spark.checkpoint.dir")
    return url.path


def materialise(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Cuts the lineage with a table in the shared folder, which outlives lost executors; also gives its path."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Rows whose Python objects exist at once in a worker.
SLICE = 512


def map_arrow(df: DataFrame, each: Callable[[pa.RecordBatch], dict], schema: T.StructType) -> DataFrame:
    """mapInArrow with a function from a record batch, of SLICE rows at most, to a dict of columns."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                columns = each(whole.slice(at, SLICE))
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name

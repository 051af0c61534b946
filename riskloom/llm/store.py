"""Tables under the shared folder of the session, and small column helpers.

Every operator that reads an intermediate result twice writes it here as
Parquet and rereads it: the lineage ends there and survives a lost executor.
The folders go when the application ends (``deleteOnExit`` of the file system).
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_package

#: Words of the contracts: runs of anything but space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``, deleted with the application."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop)  # deleteOnExit takes only what exists
    fs.deleteOnExit(hadoop)
    return path


def save(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` under the shared folder and return the table read back."""
    spark = df.sparkSession
    path = shared_folder(spark, name) + "/table"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text column, null as empty; workers that get it can import this package."""
    ship_package(df.sparkSession)
    return F.coalesce(df[column].cast("string"), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)],
        schema=schema)

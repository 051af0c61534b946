"""Versioned tables: a new version is written beside the current one, then a
pointer file is swapped in one atomic rename.

Readers follow the pointer and so see whole versions only; a writer that dies
before the swap leaves a folder that nothing points to.  ``prune`` removes such
leftovers and old versions, except those a reader may still use.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

POINTER = "CURRENT"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def current_version(spark: SparkSession, root: str) -> str | None:
    """Name of the version that the pointer names; None before the first one."""
    fs, path = _fs(spark, root)
    pointer = path(f"{root}/{POINTER}")
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def begin_version(spark: SparkSession, root: str) -> str:
    """Name of a new version; versions sort by the order of their beginnings within a root."""
    fs, path = _fs(spark, root)
    fs.mkdirs(path(root))
    taken = [f.getPath().getName() for f in fs.listStatus(path(root))]
    last = max((int(n.split("-")[1]) for n in taken if n.startswith("v-")), default=0)
    name = f"v-{last + 1:08d}-{uuid.uuid4().hex}"
    fs.mkdirs(path(f"{root}/{name}"))
    return name


def publish(spark: SparkSession, root: str, name: str) -> None:
    """Let readers see version ``name`` from now on."""
    fs, path = _fs(spark, root)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fresh = path(f"{root}/.{POINTER}-{uuid.uuid4().hex}")
    out = fs.create(fresh)
    out.write(name.encode())
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
    context.rename(fresh, path(f"{root}/{POINTER}"), how)


def write_version(df: DataFrame, root: str, fmt: str = "parquet", **options) -> str:
    """Write ``df`` as a new version of ``root`` and publish it."""
    spark = df.sparkSession
    name = begin_version(spark, root)
    df.write.format(fmt).options(**options).mode("overwrite").save(f"{root}/{name}/data")
    publish(spark, root, name)
    return name


def read_version(spark: SparkSession, root: str, schema: StructType | str, fmt: str = "parquet",
                 version: str | None = None) -> DataFrame:
    """The current (or a named) version; an empty table before the first one."""
    name = version or current_version(spark, root)
    if name is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).format(fmt).load(f"{root}/{name}/data")


def prune(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Remove all but the current version and the ``keep`` - 1 begun before it, and pointers that were never swapped in;
    the removed names.  Versions begun after the current one stay: their writers may be at work."""
    fs, path = _fs(spark, root)
    current = current_version(spark, root)
    if current is None:
        return []
    names = sorted(f.getPath().getName() for f in fs.listStatus(path(root)))
    old = [n for n in names if n.startswith("v-") and n < current]
    gone = old[:max(0, len(old) - (keep - 1))]
    for n in gone + [n for n in names if n.startswith(f".{POINTER}-")]:
        fs.delete(path(f"{root}/{n}"), True)
    return gone

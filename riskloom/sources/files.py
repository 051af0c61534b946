"""File sources and sinks: CSV / JSON / parquet with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def _fs_exists(spark: SparkSession, path: str) -> bool:
    """Hadoop-FS existence check (works for local, HDFS, S3A ...)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hpath)


def scan_csv(spark: SparkSession, path: str, schema: StructType | str | None = None,
             header: bool = True) -> DataFrame:
    """Headered CSV.  With a schema nothing is inferred (no extra pass);
    malformed fields become null (PERMISSIVE)."""
    reader = spark.read.option("header", header).option("mode", "PERMISSIVE")
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", True)
    return reader.csv(path)


def scan_first_existing(spark: SparkSession, paths: list[str], fmt: str = "parquet",
                        schema: StructType | str | None = None, **options) -> DataFrame:
    """Read the first path of ``paths`` that exists."""
    for p in paths:
        if _fs_exists(spark, p):
            reader = spark.read.format(fmt).options(**options)
            if schema is not None:
                reader = reader.schema(schema)
            return reader.load(p)
    raise FileNotFoundError(f"none of the paths exist: {paths}")


def scan_json_lookup(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON-lines lookup table; a missing path yields an empty table and
    unreadable records are dropped (never fail the job)."""
    if not _fs_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def sink_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def sink_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def sink_parquet(df: DataFrame, path: str, mode: str = "overwrite",
                 partition_by: list[str] | None = None) -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the session's reliable checkpoint directory (shared
    storage on a cluster) for intermediate tables; it goes with the application."""
    from ..session import scratch_folder
    return scratch_folder(spark, name) + "/data"

"""SparkSession construction and lineage/materialisation helpers."""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import threading
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: UTC so timestamp_ntz <-> timestamp casts are
# stable, AQE so joins re-plan on measured sizes and skewed partitions split.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def _local_driver_memory() -> str:
    """Half of physical memory, at most 16g (local mode: the driver JVM runs
    every task)."""
    try:
        total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
        return f"{max(1, min(16, int(total * 0.5) >> 30))}g"
    except (ValueError, OSError, AttributeError):
        return "4g"


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "riskloom", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    if master.startswith("local"):
        conf["spark.driver.memory"] = _local_driver_memory()
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def cluster_conf(input_bytes: int, partition_bytes: int = 256 << 20, max_partitions: int = 100_000) -> dict:
    """Sizing for a cluster run over ``input_bytes`` of input.

    Shuffle partitions start at ~one per ``partition_bytes`` of input (AQE
    coalesces small ones and splits skewed ones), scan splits match, and the
    broadcast thresholds stay small: a broadcast goes to every executor.
    """
    parts = max(200, min(max_partitions, -(-input_bytes // partition_bytes)))
    mb = f"{partition_bytes >> 20}m"
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": mb,
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": mb,
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": f"{2 * (partition_bytes >> 20)}m",
        "spark.sql.autoBroadcastJoinThreshold": "64m",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    }


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory of the session.

    On a cluster the directory named by ``spark.checkpoint.dir`` (a shared
    file system) is used as is.  Only a local-mode session without any
    setting (unit tests) gets a fresh scratch directory.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder "
            "(HDFS/S3/DBFS) before running riskloom jobs on a cluster")
    path = tempfile.mkdtemp(prefix="riskloom-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the reliable checkpoint directory, deleted when the
    application ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/riskloom-{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop)  # deleteOnExit takes only what exists
    fs.deleteOnExit(hadoop)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage by writing ``df`` as a parquet table under the reliable
    checkpoint directory and reading it back.

    Used for small side tables that are reused (computed once), for the base
    of multi-pass statistics and for iterative jobs.  Survives executor loss
    (shared storage, unlike a local checkpoint or a cache), and later passes
    read only the columns they need.  Column names that parquet cannot store
    (none, or the same twice) go through ``DataFrame.checkpoint``; a failed write
    is an error.
    """
    lower = [c.lower() for c in df.columns]
    if not all(lower) or len(set(lower)) < len(lower):
        return df.checkpoint(eager=True)
    spark = df.sparkSession
    path = scratch_folder(spark, "table") + "/data"
    df.write.parquet(path)
    return spark.read.parquet(path)


def forget(table: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote, once a later one stands in its place.  The driver's JVM is asked to
    collect: Spark removes the shuffle files of a plan when nothing refers to it any more."""
    spark = table.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        if "/riskloom-table-" in path:
            hadoop = jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(conf).delete(hadoop, True)
    jvm.System.gc()


_SHIPPED: set[str] = set()
_SHIPPING = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package: a zip of it in the shared folder, added once to the application."""
    sc, root = spark.sparkContext, Path(__file__).parent
    with _SHIPPING:
        if sc.applicationId in _SHIPPED or not root.is_dir():
            return
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for file in sorted(root.rglob("*.py")):
                z.write(file, str(file.relative_to(root.parent)))
        name = f"{root.name}-{hashlib.sha256(data.getvalue()).hexdigest()[:16]}.zip"
        path = f"{scratch_folder(spark, 'package')}/{name}"
        hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
        out = hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).create(hadoop)
        out.write(data.getvalue())
        out.close()
        sc.addPyFile(path)
        _SHIPPED.add(sc.applicationId)

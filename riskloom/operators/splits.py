"""Reproducible splits, ordered positions, sampling.

Global row positions (needed for "first 70 % by time" and exact
per-label split sizes) come from a range-partitioned sort: each partition
is sorted locally, ``monotonically_increasing_id`` gives the local index,
the per-partition counts (one row per partition) give the offsets.  The
sorted table is checkpointed first so the ids are stable under re-execution
and executor loss.  No step runs in a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .encoders import hash_unit

LOCAL_BITS = 33  # monotonically_increasing_id: partition id << 33 | local index


def with_positions(df: DataFrame, order_cols: list[str], name: str = "pos",
                   num_partitions: int | None = None) -> DataFrame:
    """0-based position of every row in ascending ``order_cols`` order."""
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = (df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
           .withColumn("__pid", F.spark_partition_id())
           .withColumn("__mid", F.monotonically_increasing_id()))
    s = materialize(s)
    counts = s.groupBy("__pid").agg(F.count(F.lit(1)).alias("__cnt"))
    offs = counts.withColumn(
        "__off", F.sum("__cnt").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)))
    offs = F.broadcast(offs.select("__pid", F.coalesce("__off", F.lit(0)).alias("__off")))  # 1 row/partition
    local = F.col("__mid") - F.shiftleft(F.col("__pid").cast("bigint"), LOCAL_BITS)
    return (s.join(offs, "__pid").withColumn(name, F.col("__off") + local)
              .drop("__pid", "__mid", "__off"))


def time_split(df: DataFrame, ts: str, id_col: str, train_frac: float = 0.70,
               valid_frac: float = 0.15) -> DataFrame:
    """Ascending time (ties by id): first ``floor(0.70 n)`` rows train, up to
    ``floor(0.85 n)`` valid, rest test.  Adds ``split``."""
    p = with_positions(df, [ts, id_col], "__pos")
    total = p.agg(F.count(F.lit(1)).alias("__n"))
    j = p.crossJoin(F.broadcast(total))
    a = F.floor(F.col("__n") * train_frac)
    b = F.floor(F.col("__n") * (train_frac + valid_frac))
    split = (F.when(F.col("__pos") < a, "train").when(F.col("__pos") < b, "valid").otherwise("test"))
    return j.withColumn("split", split).drop("__pos", "__n")


def hash_split(df: DataFrame, id_col: str, test_frac: float = 0.2, valid_frac_of_rest: float = 0.25,
               seed: int = 42) -> DataFrame:
    """Adds ``split`` by a seeded md5 draw per id, without a shuffle.  The
    label plays no part: classes keep their proportions in expectation only."""
    u = hash_unit(id_col, salt=f":{seed}")
    cut_valid = test_frac + (1.0 - test_frac) * valid_frac_of_rest
    return df.withColumn("split", F.when(u < test_frac, "test").when(u < cut_valid, "valid").otherwise("train"))


def stratified_split(df: DataFrame, label: str, id_col: str, test_frac: float = 0.2,
                     valid_frac_of_rest: float = 0.25, seed: int = 42) -> DataFrame:
    """Adds ``split`` in {train, valid, test}, exact per class.

    Rows ordered by (label, seeded md5 draw per id); within each label the
    first ``round(test_frac n_c)`` rows are test and the next
    ``round(valid (n_c - test_c))`` valid.  Positions are distributed: no class
    meets in one partition.  A null label is a class of its own.
    """
    p = with_positions(df.withColumn("__u", hash_unit(id_col, salt=f":{seed}")), [label, "__u", id_col], "__pos")
    per = p.groupBy(F.col(label).alias("__l")).agg(F.count(F.lit(1)).alias("__nc"), F.min("__pos").alias("__p0"))
    per = (per.withColumn("__kt", F.floor(F.col("__nc") * test_frac + 0.5))
              .withColumn("__kv", F.floor((F.col("__nc") - F.col("__kt")) * valid_frac_of_rest + 0.5)))
    j = p.join(per, p[label].eqNullSafe(per["__l"]))  # a row per class: broadcast when its size allows
    r = F.col("__pos") - F.col("__p0")
    split = F.when(r < F.col("__kt"), "test").when(r < F.col("__kt") + F.col("__kv"), "valid").otherwise("train")
    return j.withColumn("split", split).drop("__u", "__pos", "__l", "__nc", "__p0", "__kt", "__kv")


def sample_n(df: DataFrame, n: int, id_col: str, seed: int = 42) -> DataFrame:
    """n rows without replacement, reproducible (all rows when fewer): the
    n smallest seeded md5 draws (TakeOrderedAndProject - bounded by n)."""
    return (df.withColumn("__u", hash_unit(id_col, salt=f":{seed}"))
              .orderBy("__u", id_col).limit(n).drop("__u"))


def head_n(df: DataFrame, n: int, order_cols: list[str]) -> DataFrame:
    """First n rows in an explicit order."""
    return df.orderBy(*order_cols).limit(n)


def sort_by_event_time(df: DataFrame, ts: str, id_col: str) -> DataFrame:
    return df.orderBy(ts, id_col)

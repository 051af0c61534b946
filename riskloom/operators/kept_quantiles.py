"""Exact quantiles of a table that grows by periods, without reading it again.

Values are kept in files sorted by value within each period (a day, a month),
and an index holds each file's count, bounds and KLL sketch.  The merged
sketches bracket a quantile; files below the bracket count by their index rows,
files above it do not matter, and only those that overlap it are read, where the
exact rank is counted out.  A bracket that misses its rank is seen on the counts
and widened.
"""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .splits import with_positions

#: Size of the sketches, and the share of ranks by which a first bracket reaches beyond its target.
SKETCH_K = 1024
MARGIN = 0.005


def keep(df: DataFrame, folder: str, period: str, value: str, files: int | None = None) -> None:
    """Store the values of the periods in ``df``, which replace what was kept of those periods.  Null and NaN values and
    null periods are left out."""
    spark = df.sparkSession
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    x = F.col(value).cast("double")
    rows = df.select(F.col(period).cast("string").alias("period"), x.alias("value")).where(
        F.col("period").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value"))

    def write(frame: DataFrame, name: str) -> None:
        frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period").parquet(
            f"{folder}/{name}")

    write(rows.repartitionByRange(n, "period", "value").sortWithinPartitions("period", "value"), "values")
    stored = spark.read.schema("value double, period string").parquet(f"{folder}/values").withColumn(
        "file", F.input_file_name())
    stored = stored.join(rows.select("period").distinct(), "period", "left_semi")
    write(stored.groupBy("period", "file").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"),
        F.kll_sketch_agg_double("value", F.lit(SKETCH_K)).alias("sketch")), "index")


def index(spark: SparkSession, folder: str) -> DataFrame:
    """A row per kept file."""
    return spark.read.schema("file string, n long, least double, most double, sketch binary, period string").parquet(
        f"{folder}/index")


def overlapping(spark: SparkSession, folder: str, low: float, high: float) -> tuple[int, list[str]]:
    """(values in files wholly below ``low``, names of the files that may hold values from ``low`` to ``high``)."""
    files = index(spark, folder)
    below = files.where(F.col("most") < low).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    near = files.where((F.col("most") >= low) & (F.col("least") <= high)).select("file")
    return below, sorted(r.file for r in near.collect())  # the names of the bracket's files


def quantile(spark: SparkSession, folder: str, q: float, margin: float = MARGIN) -> float | None:
    """The linearly interpolated quantile of all kept values; None where there are none."""
    total, least, most, sketch = index(spark, folder).agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.min("least"), F.max("most"), F.kll_merge_agg_double("sketch")).first()
    if not total:
        return None
    at = q * (total - 1)
    wanted = sorted({floor(at), ceil(at)})
    sketched = spark.createDataFrame([(bytearray(sketch),)], "s binary")
    while True:
        shares = [(wanted[0] / total) - margin, ((wanted[-1] + 1) / total) + margin]
        low, high = sketched.select(*[F.kll_sketch_get_quantile_double("s", F.lit(min(1.0, max(0.0, p)))) for p in shares]
                                    ).first()
        low, high = (least if shares[0] <= 0 else low), (most if shares[1] >= 1 else high)
        below, files = overlapping(spark, folder, low, high)
        read = spark.read.schema("value double").parquet(*files)
        under, inside = read.agg(F.count_if(F.col("value") < low), F.count_if(F.col("value").between(low, high))).first()
        before = below + under
        if before <= wanted[0] and wanted[-1] < before + inside:
            break
        margin = max(2 * margin, 1e-6)  # the bracket missed
    placed = with_positions(read.where(F.col("value").between(low, high)), ["value"], "place")
    found = {r.place + before: r.value for r in placed.where(F.col("place").isin([w - before for w in wanted])).collect()}
    low, high = found[wanted[0]], found[wanted[-1]]
    return low + (high - low) * (at - floor(at))

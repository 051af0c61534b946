"""The daily series kept up to date by a stream.

Each micro-batch adds its counts per day as one folder named by the batch, so a
batch that is run again after a failure replaces its own folder and counts once.
The series is the sum over the folders: rows that come late still reach their
day.  A row is late if its day ended more than ``allowed`` before the newest time
of the batches before it; late rows are counted per day and batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.files import _fs_exists

DELTA = "batch long, day date, transactions long, frauds long, late long, newest timestamp_ntz"


def deltas(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, day, transactions, frauds, late rows, newest time) of every batch so far."""
    if not _fs_exists(spark, folder):
        return spark.createDataFrame([], DELTA)
    return spark.read.schema(DELTA).parquet(folder)


def start_daily(spark: SparkSession, source_dir: str, schema: StructType | str, folder: str, checkpoint_dir: str,
                ts: str = "transaction_ts", label: str = "is_fraudulent", id_col: str = "transaction_id",
                allowed: str = "1 day", max_files_per_trigger: int = 100, available_now: bool = True):
    """Start the stream that keeps ``folder`` up to date; returns the query.  Rows without a time have no day."""
    def add(batch: DataFrame, number: int) -> None:
        # one small row per earlier batch and day; a repeated batch does not look at itself
        newest = deltas(spark, folder).where(F.col("batch") < number).agg(F.max("newest")).first()[0]
        day = F.to_date(ts)
        late = F.lit(False) if newest is None else (
            (day + F.expr("interval 1 day") + F.expr(f"interval {allowed}")).cast("timestamp_ntz") < F.lit(newest).cast(
                "timestamp_ntz"))
        batch.where(F.col(ts).isNotNull()).groupBy(day.alias("day")).agg(
            F.count(id_col).alias("transactions"), F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0)).alias("frauds"),
            F.count_if(late).alias("late"), F.max(F.col(ts).cast("timestamp_ntz")).alias("newest")).write.mode(
            "overwrite").parquet(f"{folder}/batch={number}")

    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(source_dir)
    writer = events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def daily_series(spark: SparkSession, folder: str) -> DataFrame:
    """The series of ``aggregates.daily_series`` as of the last batch: day, transactions, frauds, fraud_rate; gaps are 0."""
    rows = deltas(spark, folder).groupBy("day").agg(F.sum("transactions").alias("n"), F.sum("frauds").alias("f"))
    span = rows.agg(F.min("day").alias("d0"), F.max("day").alias("d1"))
    days = span.select(F.explode(F.sequence("d0", "d1", F.expr("interval 1 day"))).alias("day"))
    out = days.join(rows, "day", "left").select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce("n", F.lit(0)).alias("transactions"),
        F.coalesce("f", F.lit(0)).alias("frauds"))
    return out.withColumn("fraud_rate", 100.0 * F.col("frauds") / F.greatest("transactions", F.lit(1)))


def late_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, day, late) for the days of each batch that got late rows."""
    return deltas(spark, folder).where("late > 0").select("batch", "day", "late")

"""Trailing-window activity on a stream.

The state of an entity is its events of the last window, collapsed per time and
kept by slice with the slice's totals, and the values at its last two times.  A
new time costs the totals of the whole slices in its window and the events of
the two slices at its ends.  A micro-batch reads and writes an entity's state
once.  Slices behind the last window go with it, and a timer per entity drops the
others once the watermark has passed them by a window.  State lives in the store of the query (RocksDB), on disk
and checkpointed, so a restart goes on where the last commit was.

Rows of an entity must not arrive before rows of later micro-batches that are
earlier in time; within a micro-batch any order will do.  A row that is older
than its entity's last time but not behind the watermark counts from then on
and gets the value of the time before the last one.  Rows behind the watermark
are dropped by the engine, which counts them in the query's progress.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.windows import DAY_US, wall_clock_micros
from ..session import ship_package
from ..sources.files import scratch_path

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE = "spark.sql.streaming.stateStore.providerClass"


class Velocity(StatefulProcessor):
    """(entity, us, id, amount) -> (id, entity, n, s): count and sum of the window at the entity's previous time."""

    def __init__(self, window_us: int, slices: int, kept: list[str]):
        self.window, self.slices, self.width, self.kept = window_us, slices, window_us // slices, kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getMapState("totals", "slice long", "n long, s double")
        self.events = handle.getMapState("events", "slice long", "us array<long>, n array<long>, s array<double>")
        self.last = handle.getValueState("last", "us long, n long, s double, before_n long, before_s double")

    def _expiry(self, k: int) -> int:
        """Past the watermark by a window (and the slice itself), no later row can need slice ``k``."""
        return (k + self.slices + 1) * self.width // 1000 + 1

    def _held(self) -> tuple[dict[int, tuple[int, float]], dict[int, dict[int, tuple[int, float]]]]:
        """(totals, events by time) of every slice the entity has: those of a window and of a micro-batch."""
        totals = {k: (n, s) for (k,), (n, s) in self.totals.iterator()}
        events = {k: {t: (n, s) for t, n, s in zip(*value, strict=True)} for (k,), value in self.events.iterator()}
        return totals, events

    def _window(self, us: int, totals: dict, events: dict) -> tuple[int, float]:
        """Count and sum over (us - window, us]."""
        n, s, own = 0, 0.0, us // self.width
        for k in range(own - self.slices, own + 1):
            if k not in totals:
                continue
            if own - self.slices < k < own:
                a, b = totals[k]
                n, s = n + a, s + b
                continue
            for t, (a, b) in events[k].items():
                if us - self.window < t <= us:
                    n, s = n + a, s + b
        return n, s

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("us", kind="stable")  # one entity's rows of a micro-batch
        times, amounts = batch["us"].to_numpy(), batch["amount"].to_numpy(float)
        # the state is read once and written once, whatever the number of rows
        totals, events = self._held()
        stored, touched = set(totals), set()
        last = self.last.get() if self.last.exists() else None
        n, s = np.empty(len(batch), np.int64), np.empty(len(batch))
        ends = [*np.flatnonzero(np.diff(times)) + 1, len(times)]
        for begin, end in zip([0, *ends], ends):
            us, own = int(times[begin]), amounts[begin:end]
            if last is None:
                before = (0, 0.0)
            elif us > last[0]:
                before = (last[1], last[2])
            else:
                before = (last[3], last[4])
            own = own[~np.isnan(own)]
            count, amount, k = len(own), float(own.sum()), us // self.width
            at = events.setdefault(k, {})
            a, b = at.get(us, (0, 0.0))  # the same time may be in an earlier micro-batch
            at[us] = (a + count, b + amount)
            a, b = totals.get(k, (0, 0.0))
            totals[k] = (a + count, b + amount)
            touched.add(k)
            if last is None or us >= last[0]:
                last = (us, *self._window(us, totals, events), *before)
            n[begin:end], s[begin:end] = before
        self.last.update(last)
        first = last[0] // self.width - self.slices  # no later window reaches behind it
        for k in touched:
            if k >= first:
                self.totals.updateValue((k,), totals[k])
                self.events.updateValue((k,), (list(events[k]), *map(list, zip(*events[k].values(), strict=True))))
        for k in stored:
            if k < first:
                self._drop(k)
        if not stored:  # else a timer is set
            self.handle.registerTimer(self._expiry(min(k for k in touched if k >= first)))
        yield batch[self.kept].assign(n=n, s=s)

    def _drop(self, k: int) -> None:
        self.totals.removeKey((k,))
        self.events.removeKey((k,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, now = [k for (k,) in self.totals.keys()], expiredTimerInfo.getExpiryTimeInMs()
        now = max(now, timerValues.getCurrentWatermarkInMs())
        for k in held:
            if self._expiry(k) <= now:
                self._drop(k)
        rest = [k for k in held if self._expiry(k) > now]
        if rest:
            self.handle.registerTimer(self._expiry(min(rest)))
        return iter(())

    def close(self) -> None:
        pass


def velocity_stream(events: DataFrame, id_col: str = "transaction_id", entity: str = "customer_id",
                    ts: str = "transaction_ts", amount: str = "transaction_amount", window_us: int = DAY_US,
                    suffix: str = "1d", slices: int = 24, late: str = "1 hour") -> DataFrame:
    """Streaming ``velocity``: a streaming frame of id, entity, count, sum and mean of the window at the entity's previous
    time.  Rows without an entity or a time get zeros."""
    ship_package(events.sparkSession)
    if window_us % slices or window_us // slices % 1000:
        raise ValueError("the window must be a whole number of slices of whole milliseconds")
    names = [f"tx_count_{suffix}", f"amount_sum_{suffix}", f"amount_mean_{suffix}"]
    whole = F.col(entity).isNotNull() & F.col(ts).isNotNull()
    rows = events.where(whole).select(
        F.col(id_col).alias("id"), F.col(entity).alias("entity"), wall_clock_micros(ts).alias("us"),
        F.col(amount).cast("double").alias("amount")).withColumn("at", F.timestamp_micros("us")).withWatermark("at", late)
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    schema = StructType().add("id", kinds["id"]).add("entity", kinds["entity"]).add("n", "long").add("s", "double")
    with_state = rows.groupBy("entity").transformWithStateInPandas(
        Velocity(window_us, slices, ["id", "entity"]), schema, "append", "eventTime")
    mean = F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(F.lit(0.0))
    found = with_state.select(F.col("id").alias(id_col), F.col("entity").alias(entity), F.col("n").alias(names[0]),
                              F.col("s").alias(names[1]), mean.alias(names[2]))
    rest = events.where(~whole).select(id_col, entity, F.lit(0).cast("long").alias(names[0]), F.lit(0.0).alias(names[1]),
                                       F.lit(0.0).alias(names[2]))
    return found.unionByName(rest)


def run_velocity(spark: SparkSession, source_dir: str, schema: StructType | str, sink_dir: str, checkpoint_dir: str,
                 max_files_per_trigger: int = 1, **options) -> None:
    """Read the files that are there now, oldest first, in micro-batches into a parquet sink; exactly once over restarts
    with the same checkpoint."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        events = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(source_dir)
        query = velocity_stream(events, **options).writeStream.format("parquet").outputMode("append").option(
            "checkpointLocation", checkpoint_dir).option("path", sink_dir).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)


def velocity_once(spark: SparkSession, source_dir: str, schema: StructType | str, **options) -> DataFrame:
    """``run_velocity`` over a folder of event files, the sink as a table."""
    sink, checkpoint = scratch_path(spark, "velocity-sink"), scratch_path(spark, "velocity-checkpoint")
    run_velocity(spark, source_dir, schema, sink, checkpoint, **options)
    return spark.read.parquet(sink)

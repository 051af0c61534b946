"""Trailing windows on a stream equal the batch operator, over micro-batches, ties and a restart."""

import random
from datetime import datetime, timedelta
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from riskloom.operators import windows
from riskloom.streaming import velocity as sv

DDL = "transaction_id long, customer_id long, transaction_ts timestamp_ntz, transaction_amount double"


def events(n, seed=1):
    rng = random.Random(seed)
    start, out = datetime(2024, 1, 1), []
    for i in range(n):
        start += timedelta(minutes=rng.choice([0, 0, 7, 30, 95, 400]))
        out.append((i, rng.choice([None, 1, 2, 3, 3, 3]), start, rng.choice([None, 1.0, 2.5, 100.0])))
    out[5] = (5, 1, None, 3.0)
    return out


def batch(spark, rows):
    out = windows.velocity(spark.createDataFrame(rows, DDL)).collect()
    return {r.transaction_id: (r.tx_count_1d, round(r.amount_sum_1d, 8), round(r.amount_mean_1d, 8)) for r in out}


def streamed(df):
    rows = df.collect()
    got = {r.transaction_id: (r.tx_count_1d, round(r.amount_sum_1d, 8), round(r.amount_mean_1d, 8)) for r in rows}
    assert len(got) == len(rows)
    return got


def write(spark, rows, folder):
    spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(folder)


def test_stream_equals_batch_over_a_restart(spark, tmp_path):
    rows = events(240)
    src, sink, checkpoint = (str(tmp_path / n) for n in ("src", "sink", "checkpoint"))
    schema = spark.createDataFrame([], DDL).schema
    cuts = [0, 60, 61, 130]  # ties in time may lie on both sides of a cut
    for a, b in zip(cuts, cuts[1:]):
        write(spark, rows[a:b], src)
    sv.run_velocity(spark, src, schema, sink, checkpoint)
    write(spark, rows[130:], src)
    sv.run_velocity(spark, src, schema, sink, checkpoint)
    assert streamed(spark.read.parquet(sink)) == batch(spark, rows)
    # nothing new: nothing is written twice
    sv.run_velocity(spark, src, schema, sink, checkpoint)
    assert spark.read.parquet(sink).count() == len(rows)


def test_old_slices_are_dropped(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i, 1, start + timedelta(hours=6 * i), 1.0) for i in range(40)]
    src, sink, checkpoint = (str(tmp_path / n) for n in ("src", "sink", "checkpoint"))
    for i in range(0, 40, 10):
        write(spark, rows[i:i + 10], src)
    sv.run_velocity(spark, src, spark.createDataFrame([], DDL).schema, sink, checkpoint)
    assert streamed(spark.read.parquet(sink)) == batch(spark, rows)
    held = spark.read.format("statestore").option("stateVarName", "totals").load(checkpoint).count()
    assert 0 < held < 20
    assert spark.read.parquet(sink).agg(F.max("tx_count_1d")).first()[0] == 4


class MapState:
    """A map of state that counts its calls."""

    def __init__(self):
        self.data, self.calls = {}, 0

    def _called(self, value=None):
        self.calls += 1
        return value

    def iterator(self):
        return iter(self._called(list(self.data.items())))

    def keys(self):
        return iter(self._called(list(self.data)))

    def containsKey(self, key):
        return self._called(key in self.data)

    def getValue(self, key):
        return self._called(self.data.get(key))

    def updateValue(self, key, value):
        self._called(self.data.update({key: value}))

    def removeKey(self, key):
        self._called(self.data.pop(key))


class Value:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_calls_to_the_state_do_not_grow_with_rows():
    hour, timers, maps = 3_600_000_000, [], {}
    handle = SimpleNamespace(getMapState=lambda name, *_: maps.setdefault(name, MapState()), getValueState=lambda *_: Value(),
                             registerTimer=timers.append)
    one = sv.Velocity(24 * hour, 24, ["id"])
    one.init(handle)
    calls = []
    for batch, n in ((0, 10), (1, 1000)):  # ten rows an hour apart, then a thousand
        us = [hour * (1000 * batch + i) + 7 for i in range(n)]
        rows = pd.DataFrame({"id": range(n), "us": us, "amount": [1.0] * n})
        out = pd.concat(list(one.handleInputRows((1,), iter([rows]), None)))
        assert out["n"].tolist() == ([0] if batch == 0 else [10]) + [min(i, 24) for i in range(1, n)]
        calls.append(sum(m.calls for m in maps.values()))
    assert calls[1] - calls[0] < 2 * (2 * 25 + 10 + 5)  # slices of a window, not of the rows
    assert len(timers) == 1 and {k for (k,) in maps["totals"].data} == set(range(1975, 2000))
    # the timer drops what the watermark has passed, the next one waits for the first of the rest
    late = SimpleNamespace(getCurrentWatermarkInMs=lambda: one._expiry(1980))
    assert not list(one.handleExpiredTimer((1,), late, SimpleNamespace(getExpiryTimeInMs=lambda: timers[0])))
    assert {k for (k,) in maps["events"].data} == set(range(1981, 2000)) and timers[1] == one._expiry(1981)

"""Ranges of whole numbers: a sweep line that makes them disjoint, and an as-of
merge of facts with sorted rows.

The sweep works on slices of the axis, cut at quantiles of the range starts; a
range enters every slice that it overlaps and leaves as the pieces where it is
the most specific one.  The merge sorts facts and rows together over range
partitions; each partition carries its last row forward, and the last row of a
partition goes on to those after it, so no key, however hot, has to stay in one
task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import materialize, ship_package

#: Ranges in a slice of the sweep, about.
SLICE_ROWS = 50_000


def sweep(lo: list[int], hi: list[int], begin: int | None, end: int | None) -> list[tuple[int, int, int]]:
    """(from, to, range) pieces within [begin, end) where ``range`` is the most specific one: the narrowest, of equal
    widths the one that starts last, of equal ranges the first.  Neighbouring pieces of a range are one."""
    starts = sorted(range(len(lo)), key=lambda i: lo[i])
    points = sorted({*lo, *(h + 1 for h in hi)})
    if begin is not None:
        points = [begin, *(p for p in points if p > begin)]
    out, open_, at = [], [], 0
    for p, until in zip(points, [*points[1:], None], strict=True):
        if end is not None and p >= end:
            break
        while at < len(starts) and lo[starts[at]] <= p:
            i = starts[at]
            heapq.heappush(open_, (hi[i] - lo[i], -lo[i], i))
            at += 1
        while open_ and hi[open_[0][2]] < p:
            heapq.heappop(open_)
        if not open_ or until is None:
            continue
        i, last = open_[0][2], (until if end is None else min(until, end)) - 1
        if out and out[-1][2] == i and out[-1][1] == p - 1:
            out[-1] = (out[-1][0], last, i)
        else:
            out.append((p, last, i))
    return out


def flatten_ranges(ranges: DataFrame, lo: str, hi: str, start: str = "piece_lo", stop: str = "piece_hi",
                   slices: int | None = None) -> DataFrame:
    """Disjoint pieces of ``ranges`` (both ends included), all columns kept and ``start`` / ``stop`` added: every number
    lies in a piece of the most specific range that holds it.

    Ranges with a null end or ``lo > hi`` hold nothing and are left out.  Of equal ranges the one whose columns sort
    first stays.  Repeated rows are one.
    """
    spark = ranges.sparkSession
    ship_package(spark)
    own = materialize(ranges.where((F.col(lo) <= F.col(hi))))
    n = slices or -(-own.count() // SLICE_ROWS)
    cuts = sorted({int(v) for v in own.approxQuantile(lo, [i / n for i in range(1, n)], 1 / (4 * n))}) if n > 1 else []
    if cuts:
        at = F.array(*[F.lit(c) for c in cuts])  # one number per slice
        slice_of = lambda c: F.size(F.filter(at, lambda x: x <= F.col(c)))
        dealt = own.withColumn("__slice", F.explode(F.sequence(slice_of(lo), slice_of(hi))))
    else:
        dealt = own.withColumn("__slice", F.lit(0))
    names = ranges.columns

    def run(table: pa.Table) -> pa.Table:
        k = table.column("__slice")[0].as_py()
        order = sorted(range(table.num_rows), key=lambda i: repr([table.column(c)[i].as_py() for c in names]))
        table = table.select(names).take(pa.array(order, pa.int64()))
        pieces = sweep(table.column(lo).to_pylist(), table.column(hi).to_pylist(),
                       cuts[k - 1] if k else None, cuts[k] if k < len(cuts) else None)
        out = table.take(pa.array([i for _, _, i in pieces], pa.int64()))
        for name, values in ((start, [a for a, _, _ in pieces]), (stop, [b for _, b, _ in pieces])):
            out = out.append_column(name, pa.array(values, pa.int64()))
        return out

    schema = StructType([*ranges.schema.fields]).add(start, "long").add(stop, "long")
    return dealt.groupBy("__slice").applyInArrow(run, schema)


def asof_join(facts: DataFrame, on: str, rows: DataFrame, key: str, keep: list[str] | None = None,
              num_partitions: int | None = None) -> DataFrame:
    """``facts`` with the columns ``keep`` of the row of ``rows`` whose ``key`` is the largest at or below ``on``.

    Facts before the first row, or without a key, get nulls; rows without a key are left out.  Keys of ``rows`` must be
    unique.  Columns of ``keep`` must not be columns of ``facts``.
    """
    spark = facts.sparkSession
    ship_package(spark)
    keep = keep or rows.columns
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    facts = materialize(facts)  # the bounds of the partitions, the sort and the facts without a key read them
    simple = [F.col(f.name) for f in facts.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    left = facts.where(F.col(on).isNotNull()).select(
        F.col(on).alias("key"), F.lit(1).alias("kind"), F.xxhash64(*simple).alias("salt"),
        F.struct(*facts.columns).alias("fact"))
    right = rows.where(F.col(key).isNotNull()).select(
        F.col(key).alias("key"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("salt"),
        F.struct(*keep).alias("row"))
    both = left.unionByName(right, allowMissingColumns=True)
    both = both.repartitionByRange(n, "key", "kind", "salt").sortWithinPartitions("key", "kind", "salt").select(
        F.spark_partition_id().alias("part"), "kind", "fact", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row that is carried, as a batch of one
        for b in batches:
            kind, at = b.column("kind").to_numpy(), np.arange(b.num_rows)
            seen = np.maximum.accumulate(np.where(kind == 0, at, -1))
            known = b.column("row") if last is None else pa.concat_arrays([b.column("row"), last.column("row")])
            take = pa.array(np.where(seen < 0, b.num_rows, seen),
                            mask=(seen < 0) if last is None else np.zeros(b.num_rows, bool))
            facts_at = pa.array(np.flatnonzero(kind == 1))
            yield pa.RecordBatch.from_arrays(
                [b.column("part").take(facts_at), b.column("kind").take(facts_at), b.column("fact").take(facts_at),
                 pc.take(known, take).take(facts_at)], schema=b.schema)
            if seen[-1] >= 0:
                last = b.slice(int(seen[-1]), 1)
        if last is not None:
            yield last

    merged = materialize(both.mapInArrow(run, both.schema))
    # what a partition hands on: one row per partition
    parts = merged.groupBy("part").agg(F.max(F.when(F.col("kind") == 0, F.col("row"))).alias("own"))
    carried = parts.select("part", F.last("own", ignorenulls=True).over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    found = merged.where("kind = 1").join(F.broadcast(carried), "part", "left").select(
        "fact.*", F.coalesce("row", "carried").alias("__row"))
    out = found.select(*facts.columns, *[F.col("__row")[c].alias(c) for c in keep])
    nulls = facts.where(F.col(on).isNull()).select(
        *facts.columns, *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in keep])
    return out.unionByName(nulls)

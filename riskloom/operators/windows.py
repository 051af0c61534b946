"""Per-entity totals and trailing-window (velocity) features.

Entity totals are computed as ``groupBy`` + join back rather than an
unbounded window: the aggregate is partially combined map-side, so a hot
entity never sits whole in one task, and the join back is split by AQE's
skew handling.  Rows whose entity key is null get 0 (never one shared
"null" group).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cleaning import to_numeric
from .joins import written_side

DAY_US = 86_400_000_000


def _attach(df: DataFrame, keys: list[str], aggs: list, small: bool = False,
            stats_from: DataFrame | None = None, row_id: str | None = None) -> DataFrame:
    """Group ``stats_from`` (default ``df``) by ``keys`` and left-join the
    aggregates onto ``df``.  Passing a materialised base as ``stats_from``
    keeps chained feature plans linear instead of nesting ``df`` in itself.

    ``row_id`` (never null, written with ``stats_from``, one value a row): the
    aggregates go to (row_id, keys) of ``stats_from`` and from there to ``df``
    by ``row_id``.  Calls in a chain that share it move the wide rows once."""
    cond = F.col(keys[0]).isNotNull()
    for k in keys[1:]:
        cond = cond & F.col(k).isNotNull()
    src = df if stats_from is None else stats_from
    stats = src.where(cond).groupBy(*keys).agg(*aggs)
    if small:
        stats = written_side(stats)
    if row_id is None:
        return df.join(stats, on=keys, how="left")
    found = src.where(cond).select(row_id, *keys).join(stats, on=keys).drop(*keys)
    return df.join(found, on=row_id, how="left")


def customer_totals(df: DataFrame, key: str = "customer_id", amount: str = "transaction_amount") -> DataFrame:
    """count / sum / mean (0 when no amounts) / log1p(count) per customer."""
    out = _attach(df, [key], [F.count(amount).alias("__n"), F.sum(amount).alias("__s")])
    n = F.coalesce(F.col("__n"), F.lit(0))
    s = F.coalesce(F.col("__s"), F.lit(0.0))
    return (out.withColumn("cust_txn_count", n)
               .withColumn("cust_txn_sum", s)
               .withColumn("cust_txn_mean", F.when(n > 0, s / n).otherwise(F.lit(0.0)))
               .withColumn("cust_txn_count_log", F.log1p(n))
               .drop("__n", "__s"))


def customer_totals_full(df: DataFrame, key: str = "customer_id", amount: str = "transaction_amount",
                         stats_from: DataFrame | None = None, row_id: str | None = None) -> DataFrame:
    """total count / amount / average (own amount when undefined) and logs."""
    out = _attach(df, [key], [F.count(amount).alias("__n"), F.sum(amount).alias("__s")], stats_from=stats_from,
                  row_id=row_id)
    n = F.coalesce(F.col("__n"), F.lit(0)).cast("double")
    s = F.coalesce(F.col("__s"), F.lit(0.0))
    return (out.withColumn("cust_total_txn", n)
               .withColumn("cust_total_amt", s)
               .withColumn("cust_avg_amt", F.coalesce(F.when(n > 0, s / n), to_numeric(amount)))
               .withColumn("cust_total_txn_log", F.log1p(n))
               .withColumn("cust_total_amt_log", F.coalesce(F.log1p(s), F.lit(0.0)))
               .drop("__n", "__s"))


def entity_count(df: DataFrame, keys: list[str], name: str, amount: str = "transaction_amount",
                 small: bool = False, stats_from: DataFrame | None = None, row_id: str | None = None) -> DataFrame:
    """Count of non-null amounts per entity key(s) + its log1p; null key -> 0.
    ``small=True`` for low-cardinality keys (device): the aggregate is
    written, so the planner broadcasts it when it is small and the fact table is not shuffled."""
    out = _attach(df, keys, [F.count(amount).alias("__n")], small=small, stats_from=stats_from, row_id=row_id)
    n = F.coalesce(F.col("__n"), F.lit(0)).cast("double")
    return out.withColumn(name, n).withColumn(f"{name}_log", F.log1p(n)).drop("__n")


def customer_daily_count(df: DataFrame, key: str = "customer_id", ts: str = "transaction_date",
                         amount: str = "transaction_amount") -> DataFrame:
    d = df.withColumn("__day", F.to_date(ts))
    return entity_count(d, [key, "__day"], "cust_txn_per_day", amount).drop("__day")


def customer_tx_count_ratio(df: DataFrame, key: str = "customer_id", id_col: str = "transaction_id",
                            age: str = "account_age_days") -> DataFrame:
    out = _attach(df, [key], [F.count(id_col).alias("customer_tx_count_total")])
    return out.withColumn("account_age_to_tx_ratio",
                          F.try_divide(to_numeric(age), F.col("customer_tx_count_total")))


def wall_clock_micros(ts: str) -> Column:
    """Microseconds since 1970-01-01 00:00 of the wall-clock value of a
    timestamp_ntz, by arithmetic on its fields: no session-time-zone cast."""
    t = F.col(ts).cast("timestamp_ntz")
    days = F.datediff(F.to_date(t), F.lit("1970-01-01").cast("date")).cast("long")
    secs = F.date_part(F.lit("SECOND"), t)  # decimal(8,6): seconds with fraction
    return (days * 86_400_000_000 + F.hour(t).cast("long") * 3_600_000_000
            + F.minute(t).cast("long") * 60_000_000 + (secs * 1_000_000).cast("long"))


def velocity(df: DataFrame, entity: str = "customer_id", ts: str = "transaction_ts",
             amount: str = "transaction_amount", window_us: int = DAY_US, suffix: str = "1d",
             slices: int = 24) -> DataFrame:
    """Trailing-window activity *before* each transaction.

    For each row: count / sum / mean of the entity's amounts in ``(t' - W, t']``
    where ``t'`` is the entity's previous distinct event time (0 for its first
    time).  Rows tied on time share one value, so a row never sees itself or its
    peers.

    Plan: collapse to one row per (entity, time); cut time into slices of
    ``W / slices``.  The window of a row is the end of the slice ``slices`` back,
    the whole slices between, and the start of its own slice.  The whole slices
    come from their totals (one row per entity and slice); the two ends from
    windows per (entity, slice), in which each collapsed row also appears
    ``slices`` later as expiring context.  A busy entity is so split by time down
    to a ``slices``-th of the window.  Sums only ever add amounts that are in the
    window: nothing is subtracted and no entity meets another, so an outlier or
    NaN stays with its own windows.  ``slices`` changes the split of the work,
    not the value.
    """
    us = wall_clock_micros(ts)
    width = window_us // slices
    if width * slices != window_us:
        raise ValueError("the window must be a whole number of slices")
    collapsed = (df.where(F.col(entity).isNotNull() & F.col(ts).isNotNull())
                   .groupBy(entity, us.alias("__us"))
                   .agg(F.count(amount).alias("__n"), F.sum(amount).alias("__s"))
                   .withColumn("__b", F.floor(F.col("__us") / F.lit(width))))
    between = Window.partitionBy(entity).orderBy("__b").rangeBetween(-(slices - 1), -1)
    whole = (collapsed.groupBy(entity, "__b").agg(F.sum("__n").alias("__tn"), F.sum("__s").alias("__ts"))
                      .select(entity, "__b", F.sum("__tn").over(between).alias("__wn"),
                              F.sum("__ts").over(between).alias("__ws")))
    both = (collapsed.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("__c"))
            .withColumn("__b", F.col("__b") + F.col("__c") * slices)
            .withColumn("__t", F.col("__us") + F.col("__c") * F.lit(window_us)))
    own = F.col("__c") == 0
    part = Window.partitionBy(entity, "__b")
    started = part.orderBy("__t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    unexpired = part.orderBy(F.desc("__t")).rangeBetween(Window.unboundedPreceding, -1)
    ends = both.select(
        entity, "__b", "__us", "__c",
        *[F.sum(F.when(own, F.col(c))).over(started).alias(f"{c}0") for c in ("__n", "__s")],
        *[F.sum(F.when(~own, F.col(c))).over(unexpired).alias(f"{c}1") for c in ("__n", "__s")]).where(own)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = ends.join(whole, [entity, "__b"]).select(
        entity, "__b", "__us", (zero("__n0") + zero("__n1") + zero("__wn")).alias("__n"),
        (zero("__s1") + zero("__ws") + zero("__s0")).alias("__s"))
    # the value at the previous time: in the slice, or the last one of the entity's previous slice with events
    order = part.orderBy("__us")
    rows = (rows.withColumn("__pn", F.lag("__n").over(order)).withColumn("__ps", F.lag("__s").over(order))
                .withColumn("__first", F.row_number().over(order) == 1))
    last = rows.groupBy(entity, "__b").agg(F.max_by("__n", "__us").alias("__ln"), F.max_by("__s", "__us").alias("__ls"))
    before = Window.partitionBy(entity).orderBy("__b")
    last = last.select(entity, "__b", F.lag("__ln").over(before).alias("__bn"), F.lag("__ls").over(before).alias("__bs"))
    feats = rows.join(last, [entity, "__b"])
    n = F.coalesce(F.when(F.col("__first"), F.col("__bn")).otherwise(F.col("__pn")), F.lit(0)).cast("long")
    s = F.coalesce(F.when(F.col("__first"), F.col("__bs")).otherwise(F.col("__ps")), F.lit(0.0))
    feats = feats.select(entity, "__us", n.alias(f"tx_count_{suffix}"), s.alias(f"amount_sum_{suffix}"),
                         F.when(n > 0, s / n).otherwise(F.lit(0.0)).alias(f"amount_mean_{suffix}"))
    out = df.withColumn("__us", us).join(feats, on=[entity, "__us"], how="left").drop("__us")
    return out.withColumns({c: F.coalesce(c, F.lit(0 if "count" in c else 0.0)) for c in (
        f"tx_count_{suffix}", f"amount_sum_{suffix}", f"amount_mean_{suffix}")})

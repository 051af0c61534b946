"""Grouped rates and the dashboard aggregates.

All of these are hash aggregations with map-side partial aggregation, so a
hot key (one payment method holding a third of the rows) is combined inside
each task before the shuffle and never lands whole in one reducer.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cleaning import label_text, to_numeric
from ..functions.features import day_name
from .quantiles import exact_quantiles


def _c(c):
    return F.col(c) if isinstance(c, str) else c


# ------------------------------------------------------------ rate tables


def rate_stats(df: DataFrame, keys: list[str], label: str, rate_name: str, count_name: str,
               n_col: str | None = None, pos_col: str | None = None) -> DataFrame:
    """Mean of a 0/1 label and its non-null count per key.

    Accepts either row-level input (``label``) or pre-aggregated partials
    (``n_col`` rows, ``pos_col`` positives) - the result is identical.
    """
    if n_col is not None:
        n = F.sum(n_col)
        pos = F.sum(pos_col)
    else:
        y = _c(label).cast("double")
        n = F.count(y)
        pos = F.sum(y)
    return (df.groupBy(*keys)
              .agg(n.cast("long").alias(count_name), pos.cast("double").alias("__pos"))
              .withColumn(rate_name, F.try_divide(F.col("__pos"), F.col(count_name)))
              .drop("__pos"))


def kpi_totals(df: DataFrame, label: str = "is_fraudulent", amount: str = "transaction_amount") -> DataFrame:
    n = F.count(F.lit(1))
    frauds = F.count_if(F.col(label) == 1)
    return df.agg(
        n.alias("total_tx"),
        frauds.alias("total_fraud"),
        (frauds / F.greatest(n, F.lit(1))).alias("fraud_rate"),
        F.avg(to_numeric(amount)).alias("avg_amount"),
    )


def class_counts(df: DataFrame, label: str = "is_fraudulent") -> DataFrame:
    return df.groupBy(_c(label).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("count"))


def fraud_rate_by(df: DataFrame, key: str, label: str = "is_fraudulent") -> DataFrame:
    """100 * mean(label) per key (null keys dropped, as a pandas groupby)."""
    return (df.where(F.col(key).isNotNull()).groupBy(key)
              .agg((F.avg(_c(label).cast("double")) * 100).alias("fraud_rate")))


def fraud_count_by(df: DataFrame, key: str, label: str = "is_fraudulent") -> DataFrame:
    return (df.where((F.col(label) == 1) & F.col(key).isNotNull()).groupBy(key)
              .agg(F.count(F.lit(1)).alias("fraud_count")))


def top_fraud_categories(df: DataFrame, key: str = "product_category", label: str = "is_fraudulent",
                         n: int = 20) -> DataFrame:
    """Top-n report: the limit is the feature (TakeOrderedAndProject)."""
    return fraud_count_by(df, key, label).orderBy(F.desc("fraud_count"), F.asc(key)).limit(n)


def value_counts(df: DataFrame, key: str) -> DataFrame:
    return (df.where(F.col(key).isNotNull()).groupBy(key)
              .agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), F.asc(key)))


def class_comparison(df: DataFrame, label: str, cols: list[str], digits: int = 2) -> DataFrame:
    return df.groupBy(label).agg(*[F.round(F.avg(c), digits).alias(f"mean_{c}") for c in cols])


def flag_counts(df: DataFrame, flags: list[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(f)).alias(f"n_{f}") for f in flags])


def numeric_summary(df: DataFrame, col: str) -> DataFrame:
    """mean / exact median / min / max of one column."""
    basic = df.agg(F.avg(col).alias("mean"), F.min(col).alias("min"), F.max(col).alias("max"))
    med = exact_quantiles(df, col, [0.5], names=["median"])
    return basic.crossJoin(med)


# ------------------------------------------------------------ geo


def geo_heat_cells(df: DataFrame, lat: str = "lat", lon: str = "lon", digits: int = 1) -> DataFrame:
    """Heat-map cells: count per rounded (lat, lon) on all rows."""
    return (df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
              .groupBy(F.round(lat, digits).alias("lat_cell"), F.round(lon, digits).alias("lon_cell"))
              .agg(F.count(F.lit(1)).alias("count")))


def geo_centre(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    return df.agg(F.avg(lat).alias("centre_lat"), F.avg(lon).alias("centre_lon"))


def quadkey(lat: str, lon: str, zoom: int) -> Column:
    """Key of the web-map tile of a point, a digit 0-3 per zoom level; a tile's key starts with that of the tile it lies
    in.  Latitudes beyond the map's edge lie in its outermost tiles, longitudes beyond 180 wrap around."""
    n = 1 << zoom
    rad = F.radians(F.greatest(F.least(F.col(lat).cast("double"), F.lit(85.05112878)), F.lit(-85.05112878)))
    x = F.pmod(F.floor((F.col(lon).cast("double") + 180.0) / 360.0 * n), F.lit(n)).cast("int")
    y = F.floor((1.0 - F.log(F.tan(rad) + 1.0 / F.cos(rad)) / math.pi) / 2.0 * n)
    y = F.greatest(F.least(y, F.lit(n - 1)), F.lit(0)).cast("int")
    digits = [F.shiftright(x, i).bitwiseAND(1) + 2 * F.shiftright(y, i).bitwiseAND(1) for i in range(zoom - 1, -1, -1)]
    return F.concat(*[d.cast("string") for d in digits])


def geo_heat_pyramid(df: DataFrame, lat: str = "lat", lon: str = "lon", zoom: int = 12) -> DataFrame:
    """Counts and mean position per map tile at every zoom level from 0 to ``zoom``: the rows are counted once, per tile of
    the finest level; coarser levels add up the counts of the tiles whose key starts with theirs."""
    points = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    finest = points.groupBy(quadkey(lat, lon, zoom).alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(lat).alias("lat_sum"), F.sum(lon).alias("lon_sum"))
    levels = finest.withColumn("zoom", F.explode(F.sequence(F.lit(0), F.lit(zoom))))
    return levels.groupBy("zoom", F.substr("key", F.lit(1), F.col("zoom")).alias("quadkey")).agg(
        F.sum("n").alias("count"), (F.sum("lat_sum") / F.sum("n")).alias("mean_lat"),
        (F.sum("lon_sum") / F.sum("n")).alias("mean_lon"))


# ------------------------------------------------------------ time series

# Weekday names in matrix row order.
DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def hour_dow_matrix(df: DataFrame, ts: str, label: str = "is_fraudulent") -> DataFrame:
    """Fraud count per weekday x hour, rows Monday..Sunday, 24 hour columns,
    missing cells 0.  Pivot values are fixed, so no extra job finds them."""
    spark = df.sparkSession
    frauds = df.where(F.col(label) == 1).select(
        day_name(ts).alias("dow"), F.hour(ts).alias("hour"))
    piv = frauds.groupBy("dow").pivot("hour", list(range(24))).agg(F.count(F.lit(1)))
    days = spark.createDataFrame([(i, d) for i, d in enumerate(DAY_NAMES)], "dow_idx int, dow string")
    out = F.broadcast(days).join(piv, "dow", "left")
    hours = [F.coalesce(F.col(str(h)), F.lit(0)).cast("long").alias(f"h{h:02d}") for h in range(24)]
    return out.select("dow_idx", "dow", *hours)


def daily_series(df: DataFrame, ts: str, label: str = "is_fraudulent", id_col: str = "transaction_id") -> DataFrame:
    """Per calendar day from first to last day (gaps filled with 0):
    transactions, frauds, fraud_rate = 100 * frauds / (transactions or 1)."""
    daily = (df.groupBy(F.to_date(ts).alias("day"))
               .agg(F.count(id_col).alias("transactions"), F.sum(_c(label).cast("long")).alias("frauds")))
    span = daily.agg(F.min("day").alias("d0"), F.max("day").alias("d1"))
    cal = span.select(F.explode(F.sequence("d0", "d1", F.expr("interval 1 day"))).alias("day"))
    out = cal.join(daily, "day", "left")
    out = out.select(
        F.date_format("day", "yyyy-MM-dd").alias("day"),
        F.coalesce("transactions", F.lit(0)).cast("long").alias("transactions"),
        F.coalesce("frauds", F.lit(0)).cast("long").alias("frauds"))
    return out.withColumn(
        "fraud_rate",
        100.0 * F.col("frauds") / F.when(F.col("transactions") == 0, 1).otherwise(F.col("transactions")))


def daily_ma7(daily: DataFrame, cols=("transactions", "frauds"), window: int = 7) -> DataFrame:
    """Trailing ``window``-row mean, null until a full window exists.  The
    window has no partition key: it runs on the small per-day table only
    (one row per calendar day)."""
    w = Window.orderBy("day").rowsBetween(-(window - 1), 0)
    out = daily
    for c in cols:
        out = out.withColumn(f"{c}_ma7", F.when(F.count(c).over(w) >= window, F.avg(c).over(w)))
    return out


# ------------------------------------------------------------ histograms


def nice_step(span: Column, maxbins: int) -> Column:
    """Bin step of the chart library's "nice" binning: 10^(round(log10 span)
    - ceil(log10 maxbins)), times 10 while there are more than ``maxbins``
    bins, then divided by 5 and by 2 when the bin count stays <= maxbins."""
    level = math.ceil(math.log10(maxbins))
    s0 = F.pow(F.lit(10.0), F.floor(F.log10(span) + 0.5) - level)
    for _ in range(2):
        s0 = F.when(F.ceil(span / s0) > maxbins, s0 * 10).otherwise(s0)
    s1 = F.when(span / (s0 / 5) <= maxbins, s0 / 5).otherwise(s0)
    s2 = F.when(span / (s1 / 2) <= maxbins, s1 / 2).otherwise(s1)
    return F.when(span > 0, s2).otherwise(F.lit(1.0))


def histogram(df: DataFrame, value: Column | str, maxbins: int = 50, by: str | None = None,
              max_value: float | None = None) -> DataFrame:
    """Equal-width histogram: bounds from one min/max aggregate (one row,
    broadcast), then ``floor((x - start) / step)`` and a grouped count."""
    x = _c(value).cast("double")
    base = df.select(x.alias("__x"), *([F.col(by)] if by else []))
    base = base.where(F.col("__x").isNotNull() & ~F.isnan("__x"))
    if max_value is not None:
        base = base.where(F.col("__x") <= max_value)
    mm = base.agg(F.min("__x").alias("__mn"), F.max("__x").alias("__mx"))
    mm = mm.withColumn("__step", nice_step(F.col("__mx") - F.col("__mn"), maxbins))
    mm = (mm.withColumn("__start", F.floor(F.col("__mn") / F.col("__step")) * F.col("__step"))
            .withColumn("__nb", F.greatest(F.lit(1), F.ceil((F.col("__mx") - F.col("__start")) / F.col("__step")))))
    j = base.crossJoin(F.broadcast(mm))
    idx = F.least(F.floor((F.col("__x") - F.col("__start")) / F.col("__step")), F.col("__nb") - 1)
    j = j.withColumn("bin", idx.cast("long"))
    keys = ["bin"] + ([by] if by else [])
    out = j.groupBy(*keys, "__start", "__step").agg(F.count(F.lit(1)).alias("count"))
    return out.select(
        *keys,
        (F.col("__start") + F.col("bin") * F.col("__step")).alias("bin_start"),
        (F.col("__start") + (F.col("bin") + 1) * F.col("__step")).alias("bin_end"),
        "count")


def fraud_label_col(label: str) -> Column:
    return label_text(label).alias("fraud_label")


def log1p_clipped(c: str) -> Column:
    return F.log1p(F.greatest(to_numeric(c), F.lit(0.0)))


def group_quantile_flags(df: DataFrame, key: str, value: str, lo_q: float = 0.15, hi_q: float = 0.85,
                         lo_name: str = "is_too_cheap", hi_name: str = "is_too_expensive") -> DataFrame:
    """Per-group exact quantiles joined back: value < q_lo, value > q_hi."""
    q = exact_quantiles(df, value, [lo_q, hi_q], keys=[key], names=["__qlo", "__qhi"])
    j = df.join(q, on=key, how="left")
    return (j.withColumn(lo_name, F.coalesce(F.col(value) < F.col("__qlo"), F.lit(False)))
             .withColumn(hi_name, F.coalesce(F.col(value) > F.col("__qhi"), F.lit(False)))
             .drop("__qlo", "__qhi"))


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("math",)]

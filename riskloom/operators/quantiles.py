"""Exact, distributed quantiles (linear interpolation, as pandas
``quantile`` / SQL ``percentile_cont``).

Spark's exact ``percentile`` keeps every value of a group in one buffer, so a
global or hot-group quantile on a huge table ends in one task.  Instead:

1. ``percentile_approx`` (bounded sketch, partial aggregation) brackets each
   target rank per group;
2. one scan serves all targets: each value goes once per target, as itself
   inside the bracket, as one "below" bucket under it, not at all above; rows
   are counted per (group, target, value) with map-side combine, so ties and
   everything below the bracket collapse before the shuffle;
3. the counts are cumulated in value order over range partitions of the
   distinct values (each appears once, so no group and no tie fills one task),
   and the two order statistics beside each rank are interpolated.

A bracket that misses its rank (checked on the counts) sends the call once more
through steps 2 and 3 with open brackets, which is still exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

DEFAULT_ACCURACY = 20000


def _brackets(src: DataFrame, gkeys: list[str], specs: list, value, accuracy: int) -> DataFrame:
    """One row per group: an array of (qi, lo, hi, r0, r1, fr), a struct per target with values."""
    delta = 3.0 / accuracy
    aggs = []
    for i, (_c, q, _n) in enumerate(specs):
        ends = F.array(F.lit(max(0.0, q - delta)), F.lit(min(1.0, q + delta)))
        aggs += [F.count(value(i)).alias(f"__n{i}"), F.percentile_approx(value(i), ends, accuracy).alias(f"__b{i}")]
    targets = []
    for i, (_c, q, _n) in enumerate(specs):
        pos = F.lit(q) * (F.col(f"__n{i}") - 1)
        targets.append(F.struct(F.lit(i).alias("qi"), F.col(f"__b{i}")[0].alias("lo"), F.col(f"__b{i}")[1].alias("hi"),
                                F.floor(pos).alias("r0"), F.ceil(pos).alias("r1"), (pos - F.floor(pos)).alias("fr")))
    return src.groupBy(*gkeys).agg(*aggs).select(*gkeys, F.array(*targets).alias("__targets"))


def _cumulated(src: DataFrame, bounds: DataFrame, gkeys: list[str], n_specs: int, value, open_: bool) -> DataFrame:
    """(group, qi, r0, r1, fr, cls, v, c, before): counts per distinct value and those before it."""
    # the written table tells its size: the planner broadcasts it if it is small
    joined = src.join(F.broadcast(bounds) if gkeys == ["__g"] else bounds, gkeys)
    rows = joined.select(*gkeys, F.explode(F.zip_with(
        F.col("__targets"), F.array(*[value(i) for i in range(n_specs)]),
        lambda t, x: F.struct(t["qi"].alias("qi"), t["r0"].alias("r0"), t["r1"].alias("r1"), t["fr"].alias("fr"),
                              t["lo"].alias("lo"), t["hi"].alias("hi"), x.alias("x")))).alias("t")).select(*gkeys, "t.*")
    below = F.lit(False) if open_ else F.col("x") < F.col("lo")
    kept = F.col("x").isNotNull() if open_ else F.col("x") <= F.col("hi")
    group = [*gkeys, "qi", "r0", "r1", "fr"]
    counts = rows.where(kept).groupBy(*group, (~below).cast("int").alias("cls"),
                                      F.when(~below, F.col("x")).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    parts = int(src.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(counts.repartitionByRange(parts, *gkeys, "qi", "cls", "v")
                         .withColumn("__pid", F.spark_partition_id()))
    at = ["__pid", *gkeys, "qi"]
    # at most one row per group and range partition
    earlier = Window.partitionBy(*gkeys, "qi").orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(*at).agg(F.sum("c").alias("__c")).select(
        *at, F.coalesce(F.sum("__c").over(earlier), F.lit(0)).alias("__off"))
    inside = Window.partitionBy(*at).orderBy("cls", "v").rowsBetween(Window.unboundedPreceding, -1)
    return (placed.withColumn("before", F.coalesce(F.sum("c").over(inside), F.lit(0))).join(offsets, at)
                  .withColumn("before", F.col("before") + F.col("__off")).drop("__off", "__pid"))


def exact_quantile_specs(df: DataFrame, specs: list[tuple[str, float, str]], keys: list[str] | None = None,
                         accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    """``specs``: (column, q, output name).  One row per group of ``keys``
    (one row overall without keys) with one column per spec; NaN and null
    values take no part.  A group without values, or with a null key, gives no row;
    without keys there is always one."""
    gkeys = list(keys or ["__g"])
    cols = sorted({c for c, _, _ in specs})
    src = df.select(*(keys or []), *[F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(cols)])
    if not keys:
        src = src.withColumn("__g", F.lit(0))
    if src._jdf.queryExecution().optimizedPlan().collectLeaves().size() > 1:
        src = materialize(src)  # what a join makes is computed once for both passes; a table is read twice

    def value(i):
        x = F.col(f"__x{cols.index(specs[i][0])}")
        return F.when(~F.isnan(x), x)

    bounds = materialize(_brackets(src, gkeys, specs, value, accuracy))
    for open_ in (False, True):
        ranked = _cumulated(src, bounds, gkeys, len(specs), value, open_)

        def at(rank: str, what: str):
            hit = (F.col("before") <= F.col(rank)) & (F.col(rank) < F.col("before") + F.col("c")) & (F.col("cls") == 1)
            return F.max(F.when(hit, F.col("v"))).alias(what)

        per_q = materialize(ranked.groupBy(*gkeys, "qi", "fr").agg(at("r0", "v0"), at("r1", "v1")))
        if open_ or per_q.where("v0 is null or v1 is null").isEmpty():
            break
    q = F.col("v0") + (F.col("v1") - F.col("v0")) * F.col("fr")
    out = per_q.groupBy(*gkeys).agg(*[F.max(F.when(F.col("qi") == i, q)).alias(n) for i, (_c, _q, n) in enumerate(specs)])
    if not keys:
        # a table without values still yields its one row (nulls)
        out = bounds.select("__g").join(out, "__g", "left").drop("__g")
    return out


def exact_quantiles(df: DataFrame, col: str, qs: list[float], keys: list[str] | None = None,
                    accuracy: int = DEFAULT_ACCURACY, names: list[str] | None = None) -> DataFrame:
    names = names or [f"q{int(round(q * 1000)):04d}" for q in qs]
    return exact_quantile_specs(df, [(col, q, n) for q, n in zip(qs, names)], keys, accuracy)


def exact_median(df: DataFrame, col: str, keys: list[str] | None = None, name: str = "median") -> DataFrame:
    return exact_quantiles(df, col, [0.5], keys=keys, names=[name])

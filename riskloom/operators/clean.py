"""Cleaning, imputation, de-duplication and coverage counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from ..functions.cleaning import is_finite, normalize_key
from .quantiles import exact_quantile_specs


def normalize_keys(df: DataFrame, cols: list[str], suffix: str = "_norm") -> DataFrame:
    """``<col>_norm`` = lower/strip, null -> 'nan', for each present column."""
    return df.withColumns({c + suffix: normalize_key(c) for c in cols if c in df.columns})


def impute_median(df: DataFrame, cols: list[str]) -> DataFrame:
    """Fill nulls with the exact column median (distributed quantile)."""
    present = [c for c in cols if c in df.columns]
    if not present:
        return df
    meds = exact_quantile_specs(df, [(c, 0.5, f"__med_{c}") for c in present])  # shared passes
    j = df.crossJoin(F.broadcast(meds))  # one row
    return j.withColumns({c: F.coalesce(F.col(c), F.col(f"__med_{c}")) for c in present}) \
            .drop(*[f"__med_{c}" for c in present])


def impute_constant(df: DataFrame, fills: dict) -> DataFrame:
    return df.fillna({k: v for k, v in fills.items() if k in df.columns})


def fill_zero_all(df: DataFrame) -> DataFrame:
    """inf / -inf / NaN / null -> 0 on numeric columns; strings keep nulls."""
    num = [f.name for f in df.schema.fields
           if isinstance(f.dataType, NumericType) and not isinstance(f.dataType, BooleanType)]
    return df.withColumns({c: F.when(is_finite(c), F.col(c)).otherwise(F.lit(0).cast(df.schema[c].dataType))
                           for c in num})


def fill_by_column_kind(df: DataFrame, cols: list[str]) -> DataFrame:
    """Present rate columns -> 0.0, count columns -> 0."""
    fills = {c: (0.0 if "rate" in c else 0) for c in cols if c in df.columns}
    return df.fillna(fills)


def dedup_keep_first(df: DataFrame, key: str, order_cols: list[str]) -> DataFrame:
    """Keep the earliest row per key (ordered by ``order_cols``, then a hash
    of the row for a deterministic tie-break).

    An aggregate (``min_by`` over the row struct), not a window: copies of
    one key are combined map-side, so a key duplicated into a third of the
    table never sits whole in one task."""
    cols = df.columns
    order = F.struct(*[F.col(c) for c in order_cols], F.xxhash64(*[F.col(c) for c in cols]).alias("__h"))
    best = df.groupBy(key).agg(F.min_by(F.struct(*[F.col(c) for c in cols]), order).alias("__row"))
    return best.select("__row.*")


def dedup_report(df: DataFrame, key: str) -> DataFrame:
    """One row: rows, rows kept by ``dedup_keep_first`` and rows dropped.  Null keys are one key."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    rows = F.coalesce(F.sum("n"), F.lit(0))
    return per_key.agg(rows.alias("n_rows"), F.count(F.lit(1)).alias("n_kept"),
                       (rows - F.count(F.lit(1))).alias("n_dropped"))


def coverage_report(df: DataFrame, value: str, key: str) -> DataFrame:
    """rows, valid numeric values, distinct keys, duplicate rows (by key)."""
    dist = df.select(key).distinct().agg(F.count(F.lit(1)).alias("n_distinct_keys"))
    base = df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.count(F.col(value).try_cast("double")).alias("n_valid_numeric"))
    return base.crossJoin(dist).withColumn("n_duplicates", F.col("n_rows") - F.col("n_distinct_keys"))

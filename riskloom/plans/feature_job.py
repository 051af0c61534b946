"""Offline feature job: transactions + counterfeit side rates -> model-ready
feature table.  Side rates, the row-wise base and its statistics are written as
they are built; the returned table is a lazy chain of joins over them.

Shuffles at scale: the three side-rate tables are pre-aggregated (their
inputs are collapsed before their own joins) and written, so the planner
broadcasts them by their size and the fact table is not shuffled for them; per-entity counts are
grouped (map-side combine), joined to the rows' numbers (AQE splits hot keys) and from
there to the wide rows, which move once for all of them; the 95 %
quantile and the medians use the distributed exact quantile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import features as ff
from ..functions.cleaning import normalize_key, to_numeric
from ..operators import clean, windows
from ..operators.joins import cross_join_scalar, enrich_left
from ..operators.quantiles import exact_quantile_specs
from ..session import materialize
from ..sources import fixtures as fx

RATE_COLS = ["cnt_txn_counterfeit_rate_pm", "cnt_txn_count_pm", "cnt_txn_counterfeit_rate_loc_pm",
             "cnt_txn_count_loc_pm", "cnt_prod_counterfeit_rate_cat", "cnt_prod_count_cat"]
#: Number of a row of the written base.
ROW = "__row"


def side_rates(spark, sf) -> dict[str, DataFrame]:
    from .q_aggregates import category_rates, location_payment_rates, payment_rates
    # both transaction-side rate tables come from one pre-aggregated pass
    parts = materialize(fx.counterfeit_transaction_partials(spark, sf))
    return {"pm": payment_rates(spark, sf, parts), "loc_pm": location_payment_rates(spark, sf, parts),
            "cat": category_rates(spark, sf)}


def enrich_with_rates(t: DataFrame, rates: dict[str, DataFrame]) -> DataFrame:
    t = t.withColumns({c + "_norm": normalize_key(c) for c in ("payment_method", "product_category",
                                                               "customer_location") if c in t.columns})
    t = enrich_left(t, rates["pm"], ["payment_method_norm"])
    t = enrich_left(t, rates["loc_pm"], ["customer_location_norm", "payment_method_norm"])
    t = enrich_left(t, rates["cat"], ["product_category_norm"], ["category_norm"], keep_right_keys=False)
    return clean.fill_by_column_kind(t, RATE_COLS)


def engineer(t: DataFrame) -> DataFrame:
    """Date, hour, amount, age and per-entity features on an enriched table.

    The enriched rows are written once with a number each (``materialize``);
    every statistic (95 % quantile, medians, entity counts) is computed from
    that base.  Entity counts come back by the row's number, so the wide rows
    are shuffled once for all entities, and what follows from a row's own
    columns is computed after that.
    """
    t = t.withColumn("transaction_date", F.col("transaction_date").cast("timestamp_ntz"))
    t = t.withColumns({
        "tx_date": F.to_date("transaction_date"),
        "tx_dayofweek": ff.weekday("transaction_date"),
        "tx_day": F.dayofmonth("transaction_date"),
        "tx_month": F.month("transaction_date"),
        "transaction_hour": F.coalesce(to_numeric("transaction_hour"), F.lit(-1.0)).cast("int"),
        "transaction_amount": F.coalesce(to_numeric("transaction_amount"), F.lit(0.0)),
        "account_age_days": to_numeric("account_age_days"),
        "customer_age": to_numeric("customer_age"),
    })
    own = t.columns
    base = materialize(t.withColumn(ROW, F.monotonically_increasing_id()))

    t = windows.entity_count(base, ["customer_id", "tx_date"], "cust_txn_per_day", stats_from=base, row_id=ROW)
    t = windows.customer_totals_full(t, stats_from=base, row_id=ROW)
    t = windows.entity_count(t, ["ip_address"], "ip_txn_count", stats_from=base, row_id=ROW)
    t = windows.entity_count(t.drop(ROW), ["device_used"], "device_txn_count", small=True, stats_from=base)
    entity = [c for c in t.columns if c not in own]

    t = t.withColumns({
        "hour_sin": ff.hour_sin("transaction_hour"), "hour_cos": ff.hour_cos("transaction_hour"),
        "is_night": ff.is_night("transaction_hour"), "is_weekend": ff.is_weekend("tx_dayofweek"),
        "log_amount": ff.log_amount("transaction_amount"),
        "amount_per_unit": ff.amount_per_unit("transaction_amount", "quantity"),
    })
    scal = exact_quantile_specs(base, [("transaction_amount", 0.95, "__q95"),
                                       ("account_age_days", 0.5, "__med_account_age_days"),
                                       ("customer_age", 0.5, "__med_customer_age")])
    t = cross_join_scalar(t, scal)  # one row
    t = t.withColumns({
        "is_high_amount": ff.is_high_amount("transaction_amount", "__q95"),
        "account_age_days": F.coalesce("account_age_days", "__med_account_age_days"),
        "customer_age": F.coalesce("customer_age", "__med_customer_age"),
    }).drop("__q95", "__med_account_age_days", "__med_customer_age")
    t = t.withColumns({"account_age_bucket": ff.account_age_bucket("account_age_days"),
                       "customer_age_bucket": ff.customer_age_bucket("customer_age")})
    keys = ["device_used", "ip_address", "customer_id", "tx_date"]
    t = t.select(*keys, *(c for c in t.columns if c not in {*keys, *entity}), *entity)
    return clean.fill_zero_all(t)


def build_features(spark, sf) -> DataFrame:
    """The full feature table for ``txn_o``."""
    return engineer(enrich_with_rates(fx.transactions_orders(spark, sf), side_rates(spark, sf)))

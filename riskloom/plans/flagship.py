"""Flagship query: payment-method risk overview.

txn_o (orders x customer x nation, line totals) is enriched with the
counterfeit-rate side table by normalised payment method (checked broadcast
join, side table pre-aggregated before its own joins), then aggregated per
payment method.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.cleaning import normalize_key
from ..operators.joins import enrich_left
from ..sources import fixtures as fx
from .common import CF_TXN_CTE, TXN_O_CTE, finalize, norm_sql, register
from .q_aggregates import payment_rates


def payment_risk_overview(spark, sf):
    t = fx.transactions_orders(spark, sf).withColumn("payment_method_norm", normalize_key("payment_method"))
    j = enrich_left(t, payment_rates(spark, sf), ["payment_method_norm"])
    j = j.fillna({"cnt_txn_counterfeit_rate_pm": 0.0, "cnt_txn_count_pm": 0})
    out = j.groupBy("payment_method").agg(
        F.count(F.lit(1)).alias("transactions"),
        (F.avg(F.col("is_fraudulent").cast("double")) * 100).alias("fraud_rate"),
        F.avg("cnt_txn_counterfeit_rate_pm").alias("counterfeit_rate"),
        F.max("cnt_txn_count_pm").alias("side_count"),
        F.avg("transaction_amount").alias("avg_amount"))
    return finalize(out, money=("avg_amount",))


register("payment_risk_overview", f"""
WITH {TXN_O_CTE}, {CF_TXN_CTE},
stats AS (SELECT {norm_sql('payment_method')} AS payment_method_norm,
                 avg(CAST(involves_counterfeit AS DOUBLE)) AS rate, count(involves_counterfeit) AS cnt
          FROM cf_txn GROUP BY 1),
j AS (SELECT t.*, coalesce(s.rate, 0.0) AS rate, coalesce(s.cnt, 0) AS cnt
      FROM txn_o t LEFT JOIN stats s ON {norm_sql('t.payment_method')} = s.payment_method_norm)
SELECT payment_method, count(*) AS transactions,
       round(avg(CAST(is_fraudulent AS DOUBLE)) * 100, 6) AS fraud_rate,
       round(avg(rate), 6) AS counterfeit_rate, CAST(max(cnt) AS BIGINT) AS side_count,
       round(avg(transaction_amount), 4) AS avg_amount
FROM j GROUP BY 1""")(payment_risk_overview)

"""Registered queries: per-entity and trailing-window features, encoders,
ordering, splits and sampling (SURVEY 2.6, 2.7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features as ff
from ..operators import encoders as enc
from ..operators import splits as sp
from ..operators import windows as win
from ..sources import files
from ..sources import fixtures as fx
from .common import TXN_E_CTE, TXN_O_CTE, finalize, md5_bucket_sql, md5_unit_sql, register

# Some customer keys are blanked so the null-entity rule is exercised.
NULL_CUSTOMER_EVERY = 23


def txn_null_customers(spark, sf):
    t = fx.transactions_orders(spark, sf)
    return t.withColumn("customer_id", F.when(F.pmod("transaction_id", F.lit(NULL_CUSTOMER_EVERY)) != 0,
                                              F.col("customer_id")))


TXN_NC_CTE = TXN_O_CTE + f""",
txn AS (SELECT * REPLACE (CASE WHEN transaction_id % {NULL_CUSTOMER_EVERY} <> 0 THEN customer_id END AS customer_id)
        FROM txn_o)"""


@register("customer_totals", f"""
WITH {TXN_NC_CTE},
g AS (SELECT customer_id, count(transaction_amount) AS n, sum(transaction_amount) AS s FROM txn
      WHERE customer_id IS NOT NULL GROUP BY 1)
SELECT t.transaction_id, coalesce(g.n, 0) AS cust_txn_count, round(coalesce(g.s, 0.0), 8) AS cust_txn_sum,
       round(CASE WHEN coalesce(g.n, 0) > 0 THEN g.s / g.n ELSE 0.0 END, 8) AS cust_txn_mean,
       round(ln(1 + coalesce(g.n, 0)), 6) AS cust_txn_count_log
FROM txn t LEFT JOIN g ON t.customer_id = g.customer_id""")
def q_customer_totals(spark, sf):
    out = win.customer_totals(txn_null_customers(spark, sf))
    return finalize(out.select("transaction_id", "cust_txn_count", "cust_txn_sum", "cust_txn_mean",
                               "cust_txn_count_log"), money=("cust_txn_sum", "cust_txn_mean"), money_digits=8)


@register("customer_totals_full", f"""
WITH {TXN_NC_CTE},
g AS (SELECT customer_id, count(transaction_amount) AS n, sum(transaction_amount) AS s FROM txn
      WHERE customer_id IS NOT NULL GROUP BY 1)
SELECT t.transaction_id, CAST(coalesce(g.n, 0) AS DOUBLE) AS cust_total_txn,
       round(coalesce(g.s, 0.0), 8) AS cust_total_amt,
       round(coalesce(CASE WHEN coalesce(g.n, 0) > 0 THEN g.s / g.n END, t.transaction_amount), 8) AS cust_avg_amt,
       round(ln(1 + coalesce(g.n, 0)), 6) AS cust_total_txn_log,
       round(coalesce(ln(1 + coalesce(g.s, 0.0)), 0.0), 6) AS cust_total_amt_log
FROM txn t LEFT JOIN g ON t.customer_id = g.customer_id""")
def q_customer_totals_full(spark, sf):
    out = win.customer_totals_full(txn_null_customers(spark, sf))
    return finalize(out.select("transaction_id", "cust_total_txn", "cust_total_amt", "cust_avg_amt",
                               "cust_total_txn_log", "cust_total_amt_log"), money=("cust_total_amt", "cust_avg_amt"),
                    money_digits=8)


@register("customer_daily_count", f"""
WITH {TXN_E_CTE},
g AS (SELECT customer_id, CAST(transaction_ts AS DATE) AS d, count(transaction_amount) AS n FROM txn_e
      WHERE customer_id IS NOT NULL GROUP BY 1, 2)
SELECT t.transaction_id, CAST(coalesce(g.n, 0) AS DOUBLE) AS cust_txn_per_day,
       round(ln(1 + coalesce(g.n, 0)), 6) AS cust_txn_per_day_log
FROM txn_e t LEFT JOIN g ON t.customer_id = g.customer_id AND CAST(t.transaction_ts AS DATE) = g.d""")
def q_customer_daily_count(spark, sf):
    out = win.customer_daily_count(fx.transactions_events(spark, sf), ts="transaction_ts")
    return finalize(out.select("transaction_id", "cust_txn_per_day", "cust_txn_per_day_log"))


def _count_sql(key: str, name: str) -> str:
    return f"""
WITH {TXN_O_CTE},
g AS (SELECT {key} AS k, count(transaction_amount) AS n FROM txn_o WHERE {key} IS NOT NULL GROUP BY 1)
SELECT t.transaction_id, CAST(coalesce(g.n, 0) AS DOUBLE) AS {name},
       round(ln(1 + coalesce(g.n, 0)), 6) AS {name}_log
FROM txn_o t LEFT JOIN g ON t.{key} = g.k"""


@register("ip_txn_count", _count_sql("ip_address", "ip_txn_count"))
def q_ip_txn_count(spark, sf):
    out = win.entity_count(fx.transactions_orders(spark, sf), ["ip_address"], "ip_txn_count")
    return finalize(out.select("transaction_id", "ip_txn_count", "ip_txn_count_log"))


@register("device_txn_count", _count_sql("device_used", "device_txn_count"))
def q_device_txn_count(spark, sf):
    out = win.entity_count(fx.transactions_orders(spark, sf), ["device_used"], "device_txn_count", small=True)
    return finalize(out.select("transaction_id", "device_txn_count", "device_txn_count_log"))


def _velocity_sql(window_us: int, suffix: str) -> str:
    return f"""
WITH {TXN_E_CTE},
c AS (SELECT customer_id, epoch_us(transaction_ts) AS us, count(transaction_amount) AS n,
             sum(transaction_amount) AS s FROM txn_e
      WHERE customer_id IS NOT NULL AND transaction_ts IS NOT NULL GROUP BY 1, 2),
w AS (SELECT customer_id, us,
             sum(n) OVER (PARTITION BY customer_id ORDER BY us RANGE BETWEEN {window_us - 1} PRECEDING AND CURRENT ROW) AS wn,
             sum(s) OVER (PARTITION BY customer_id ORDER BY us RANGE BETWEEN {window_us - 1} PRECEDING AND CURRENT ROW) AS ws
      FROM c),
l AS (SELECT customer_id, us, lag(wn) OVER (PARTITION BY customer_id ORDER BY us) AS pn,
             lag(ws) OVER (PARTITION BY customer_id ORDER BY us) AS ps FROM w)
SELECT t.transaction_id, CAST(coalesce(l.pn, 0) AS BIGINT) AS tx_count_{suffix},
       round(coalesce(l.ps, 0.0), 8) AS amount_sum_{suffix},
       round(CASE WHEN coalesce(l.pn, 0) > 0 THEN coalesce(l.ps, 0.0) / l.pn ELSE 0.0 END, 8) AS amount_mean_{suffix}
FROM txn_e t LEFT JOIN l ON t.customer_id = l.customer_id AND epoch_us(t.transaction_ts) = l.us"""


@register("velocity_1d", _velocity_sql(win.DAY_US, "1d"))
def q_velocity_1d(spark, sf):
    out = win.velocity(fx.transactions_events(spark, sf), window_us=win.DAY_US, suffix="1d")
    return finalize(out.select("transaction_id", "tx_count_1d", "amount_sum_1d", "amount_mean_1d"), digits=8)


@register("stream_velocity_1d", _velocity_sql(win.DAY_US, "1d"))
def q_stream_velocity_1d(spark, sf):
    """The same on a stream: events staged in order of time as four sets of files, read in micro-batches with state."""
    from ..streaming.velocity import velocity_once
    e = fx.transactions_events(spark, sf).select("transaction_id", "customer_id", "transaction_ts", "transaction_amount")
    quarter = e.agg(*[F.percentile_approx("transaction_ts", q / 4).alias(f"q{q}") for q in (1, 2, 3)]).first()
    src = files.scratch_path(spark, "velocity-events")
    for low, high in zip((None, *quarter), (*quarter, None), strict=True):  # files are read oldest first, a set at a time
        part = e if low is None else e.where(F.col("transaction_ts") > low)
        part = part if high is None else part.where(F.col("transaction_ts") <= high)
        part.repartition(8).write.mode("append").parquet(src)
    out = velocity_once(spark, src, e.schema, max_files_per_trigger=8)
    return finalize(out.select("transaction_id", "tx_count_1d", "amount_sum_1d", "amount_mean_1d"), digits=8)


@register("velocity_7d", _velocity_sql(7 * win.DAY_US, "7d"))
def q_velocity_7d(spark, sf):
    out = win.velocity(fx.transactions_events(spark, sf), window_us=7 * win.DAY_US, suffix="7d")
    return finalize(out.select("transaction_id", "tx_count_7d", "amount_sum_7d", "amount_mean_7d"), digits=8)


@register("customer_tx_count_ratio", f"""
WITH {TXN_NC_CTE},
g AS (SELECT customer_id, count(transaction_id) AS n FROM txn WHERE customer_id IS NOT NULL GROUP BY 1)
SELECT t.transaction_id, g.n AS customer_tx_count_total,
       round(CAST(t.account_age_days AS DOUBLE) / g.n, 6) AS account_age_to_tx_ratio
FROM txn t LEFT JOIN g ON t.customer_id = g.customer_id""")
def q_customer_tx_count_ratio(spark, sf):
    out = win.customer_tx_count_ratio(txn_null_customers(spark, sf))
    return finalize(out.select("transaction_id", "customer_tx_count_total", "account_age_to_tx_ratio"))


# ------------------------------------------------------------ encoders (fit on train only)

SPLIT_SQL = (f"CASE WHEN {md5_unit_sql('transaction_id', ':42')} < 0.2 THEN 'test' "
             f"WHEN {md5_unit_sql('transaction_id', ':42')} < 0.4 THEN 'valid' ELSE 'train' END")


def split_txn(spark, sf):
    return sp.hash_split(fx.transactions_orders(spark, sf), "transaction_id")


@register("frequency_encode", f"""
WITH {TXN_O_CTE}, s AS (SELECT *, {SPLIT_SQL} AS split FROM txn_o),
f AS (SELECT customer_id, count(*) AS n FROM s WHERE split = 'train' AND customer_id IS NOT NULL GROUP BY 1)
SELECT s.transaction_id, s.split,
       CASE WHEN s.split = 'train' THEN CAST(f.n AS DOUBLE) ELSE CAST(coalesce(f.n, 0) AS DOUBLE) END AS customer_id_freq
FROM s LEFT JOIN f ON s.customer_id = f.customer_id""")
def q_frequency_encode(spark, sf):
    res = enc.encode_by_split(split_txn(spark, sf), ["customer_id"])
    return finalize(res.select("transaction_id", "split", "customer_id_freq"))


DOC_SPLIT = (f"CASE WHEN {md5_unit_sql('d.doc_id', ':42')} < 0.2 THEN 'test' "
             f"WHEN {md5_unit_sql('d.doc_id', ':42')} < 0.4 THEN 'valid' ELSE 'train' END")


@register("frequency_encode_missing", f"""
WITH s AS (SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), 'missing') AS quality_cat,
                  coalesce(d.lang, 'missing') AS lang, {DOC_SPLIT} AS split
           FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
f1 AS (SELECT quality_cat, count(*) AS n FROM s WHERE split = 'train' GROUP BY 1),
f2 AS (SELECT lang, count(*) AS n FROM s WHERE split = 'train' GROUP BY 1)
SELECT s.doc_id, s.split, CAST(coalesce(f1.n, 0) AS DOUBLE) AS quality_cat_freq,
       CAST(coalesce(f2.n, 0) AS DOUBLE) AS lang_freq
FROM s LEFT JOIN f1 ON s.quality_cat = f1.quality_cat LEFT JOIN f2 ON s.lang = f2.lang""")
def q_frequency_encode_missing(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id", "lang")
    lab = fx.table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("quality_cat"))
    j = d.join(lab, "doc_id", "left")
    j = sp.hash_split(j, "doc_id")
    cats = ["quality_cat", "lang"]
    res = enc.encode_by_split(j.fillna(dict.fromkeys(cats, "missing")), cats).fillna(0.0, [f"{c}_freq" for c in cats])
    return finalize(res.select("doc_id", "split", "quality_cat_freq", "lang_freq"))


@register("target_encode_kfold", f"""
WITH {TXN_O_CTE}, s AS (SELECT *, {SPLIT_SQL} AS split, {md5_bucket_sql('transaction_id', 5)} AS fold FROM txn_o),
tr AS (SELECT * FROM s WHERE split = 'train'),
g AS (SELECT avg(CAST(is_fraudulent AS DOUBLE)) AS g FROM tr),
pf AS (SELECT customer_location, fold, sum(CAST(is_fraudulent AS DOUBLE)) AS sf, count(*) AS nf FROM tr
       WHERE customer_location IS NOT NULL GROUP BY 1, 2),
pc AS (SELECT customer_location, sum(sf) AS sc, sum(nf) AS nc FROM pf GROUP BY 1),
oof AS (SELECT pf.customer_location, pf.fold, pf.nf,
               (pc.sc - pf.sf + 100.0 * g.g) / (pc.nc - pf.nf + 100.0) AS te
        FROM pf JOIN pc ON pf.customer_location = pc.customer_location CROSS JOIN g),
full_ AS (SELECT customer_location, sum(te * nf) / sum(nf) AS te FROM oof GROUP BY 1)
SELECT s.transaction_id, s.split,
       round(CASE WHEN s.split = 'train' THEN coalesce(o.te, g.g) ELSE coalesce(fu.te, g.g) END, 6)
         AS customer_location_te
FROM s CROSS JOIN g
LEFT JOIN oof o ON s.split = 'train' AND s.customer_location = o.customer_location AND s.fold = o.fold
LEFT JOIN full_ fu ON s.customer_location = fu.customer_location""")
def q_target_encode_kfold(spark, sf):
    rows = split_txn(spark, sf).select("transaction_id", "split", "customer_location", "is_fraudulent")
    res = enc.encode_by_split(rows, ["customer_location"], "is_fraudulent", "transaction_id")
    return finalize(res.select("transaction_id", "split", "customer_location_te"))


# ------------------------------------------------------------ 2.7 ordering, splits, sampling


@register("sort_by_event_time", f"""
WITH {TXN_O_CTE}, d AS (SELECT transaction_id, transaction_date + to_hours(transaction_hour) AS dt FROM txn_o)
SELECT transaction_id, dt AS transaction_datetime, row_number() OVER (ORDER BY dt, transaction_id) - 1 AS pos
FROM d""")
def q_sort_by_event_time(spark, sf):
    t = fx.transactions_orders(spark, sf).select(
        "transaction_id", ff.date_plus_hours("transaction_date", "transaction_hour").alias("transaction_datetime"))
    return finalize(sp.with_positions(t, ["transaction_datetime", "transaction_id"], "pos"))


@register("time_split_70_15_15", f"""
WITH {TXN_E_CTE}, p AS (SELECT transaction_id, row_number() OVER (ORDER BY transaction_ts, transaction_id) - 1 AS pos,
                              count(*) OVER () AS n FROM txn_e)
SELECT transaction_id, CASE WHEN pos < floor(n * 0.7) THEN 'train' WHEN pos < floor(n * 0.85) THEN 'valid'
                            ELSE 'test' END AS split FROM p""")
def q_time_split_70_15_15(spark, sf):
    t = fx.transactions_events(spark, sf).select("transaction_id", "transaction_ts")
    return sp.time_split(t, "transaction_ts", "transaction_id").select("transaction_id", "split")


def _split_sql(test: float, valid: float) -> str:
    u = md5_unit_sql("transaction_id", ":42")
    return f"""
WITH {TXN_O_CTE},
r AS (SELECT transaction_id, is_fraudulent,
             row_number() OVER (PARTITION BY is_fraudulent ORDER BY {u}, transaction_id) - 1 AS r,
             count(*) OVER (PARTITION BY is_fraudulent) AS nc FROM txn_o),
k AS (SELECT *, floor(nc * {test} + 0.5) AS kt FROM r),
k2 AS (SELECT *, floor((nc - kt) * {valid} + 0.5) AS kv FROM k)
SELECT transaction_id, is_fraudulent,
       CASE WHEN r < kt THEN 'test' WHEN r < kt + kv THEN 'valid' ELSE 'train' END AS split FROM k2"""


@register("stratified_split_60_20_20", _split_sql(0.2, 0.25))
def q_stratified_split_60_20_20(spark, sf):
    t = fx.transactions_orders(spark, sf).select("transaction_id", "is_fraudulent")
    return finalize(sp.stratified_split(t, "is_fraudulent", "transaction_id", 0.2, 0.25))


@register("stratified_split_56_14_30", _split_sql(0.3, 0.2))
def q_stratified_split_56_14_30(spark, sf):
    t = fx.transactions_orders(spark, sf).select("transaction_id", "is_fraudulent")
    return finalize(sp.stratified_split(t, "is_fraudulent", "transaction_id", 0.3, 0.2))


@register("stratified_split_exact", _split_sql(0.2, 0.25))
def q_stratified_split_exact(spark, sf):
    t = fx.transactions_orders(spark, sf).select("transaction_id", "is_fraudulent")
    return finalize(sp.stratified_split(t, "is_fraudulent", "transaction_id", 0.2, 0.25))


@register("sample_n_seeded", f"""
WITH {TXN_O_CTE}
SELECT transaction_id, transaction_amount FROM txn_o
ORDER BY {md5_unit_sql('transaction_id', ':42')}, transaction_id LIMIT 2000""")
def q_sample_n_seeded(spark, sf):
    t = fx.transactions_orders(spark, sf).select("transaction_id", "transaction_amount")
    return finalize(sp.sample_n(t, 2000, "transaction_id"))


@register("scatter_sample", f"""
WITH {TXN_O_CTE}
SELECT transaction_id, customer_id, customer_age, account_age_days, transaction_amount, is_fraudulent,
       CASE WHEN is_fraudulent = 1 THEN 'Fraud' WHEN is_fraudulent = 0 THEN 'Legit'
            ELSE CAST(is_fraudulent AS VARCHAR) END AS fraud_label
FROM txn_o WHERE account_age_days IS NOT NULL AND transaction_amount IS NOT NULL
ORDER BY {md5_unit_sql('transaction_id', ':42')}, transaction_id LIMIT 2000""")
def q_scatter_sample(spark, sf):
    from ..functions.cleaning import label_text
    t = fx.transactions_orders(spark, sf).select("transaction_id", "customer_id", "customer_age", "account_age_days",
                                                 "transaction_amount", "is_fraudulent")
    t = t.na.drop(subset=["account_age_days", "transaction_amount"])
    s = sp.sample_n(t, 2000, "transaction_id")
    return finalize(s.withColumn("fraud_label", label_text("is_fraudulent")))


@register("head_n", f"""
WITH {TXN_O_CTE} SELECT transaction_id, transaction_amount FROM txn_o ORDER BY transaction_id LIMIT 50""")
def q_head_n(spark, sf):
    t = fx.transactions_orders(spark, sf).select("transaction_id", "transaction_amount")
    return finalize(sp.head_n(t, 50, ["transaction_id"]))

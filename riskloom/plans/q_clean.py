"""Registered queries: sources/sinks, projections and schema helpers,
cleaning, and scalar feature functions (SURVEY 2.1-2.3, 2.9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cleaning as fc
from ..functions import features as ff
from ..operators import clean, encoders, schema
from ..operators.quantiles import exact_quantiles
from ..sources import files
from ..sources import fixtures as fx
from .common import LISTINGS_CTE, TXN_E_CTE, TXN_O_CTE, finalize, norm_sql, register

# ------------------------------------------------------------ 2.1 sources / sinks

ORDERS_SCHEMA = ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
                 "o_orderdate timestamp_ntz, o_orderpriority string")


@register("scan_csv", "SELECT * FROM orders")
def q_scan_csv(spark, sf):
    """Round trip: orders written as headered CSV, read back with a schema."""
    path = files.scratch_path(spark, "orders-csv")
    files.sink_csv(fx.table(spark, sf, "orders"), path)
    return files.scan_csv(spark, path, ORDERS_SCHEMA)


@register("scan_first_existing", "SELECT * FROM customer")
def q_scan_first_existing(spark, sf):
    return files.scan_first_existing(spark, [f"{sf}/no_such_table.parquet", f"{sf}/customer.parquet"])


LOOKUP_SCHEMA = "ip string, country string"


def _ip_lookup(spark, sf):
    """ip -> country cache rows (null country for unresolvable ranges)."""
    from ..operators.joins import ip_range_join
    e = fx.transactions_events(spark, sf).select("ip_address", "ip_number")
    g = ip_range_join(e, "ip_number", fx.ip_ranges(spark, sf))
    return g.select(F.col("ip_address").alias("ip"), F.col("country")).distinct()


RANGES_AND_EVENTS = f"""
WITH {TXN_E_CTE}, ip_ranges AS (
  SELECT CAST(floor(n_nationkey * 4294967296 / 25) AS BIGINT) AS ip_lo,
         CAST(floor((n_nationkey + 1) * 4294967296 / 25) - 1 AS BIGINT) AS ip_hi,
         ({fx.NATION_NAMES})[CAST(n_nationkey % 25 AS INTEGER) + 1] AS country FROM nation)"""


@register("scan_json_lookup", RANGES_AND_EVENTS + """
SELECT DISTINCT t.ip_address AS ip, r.country FROM txn_e t
LEFT JOIN ip_ranges r ON t.ip_number BETWEEN r.ip_lo AND r.ip_hi""")
def q_scan_json_lookup(spark, sf):
    """Lookup written as JSON lines then read back; a missing cache reads as
    an empty table and is unioned in (no failure)."""
    path = files.scratch_path(spark, "ip-cache")
    files.sink_json(_ip_lookup(spark, sf), path)
    cache = files.scan_json_lookup(spark, path, LOOKUP_SCHEMA)
    missing = files.scan_json_lookup(spark, path + "-absent", LOOKUP_SCHEMA)
    return cache.unionByName(missing)


@register("sink_csv", f"WITH {LISTINGS_CTE} SELECT transaction_id, product_category, discount_percentage, "
                      "reviews_count, is_fraud FROM listings")
def q_sink_csv(spark, sf):
    cols = "transaction_id bigint, product_category string, discount_percentage int, reviews_count int, is_fraud int"
    path = files.scratch_path(spark, "listings-csv")
    files.sink_csv(fx.listings(spark, sf).select(*[c.split()[0] for c in cols.split(", ")]), path)
    return finalize(files.scan_csv(spark, path, cols))


@register("sink_json", RANGES_AND_EVENTS + """
SELECT t.ip_address AS ip, count(*) AS n FROM txn_e t GROUP BY 1""")
def q_sink_json(spark, sf):
    path = files.scratch_path(spark, "ip-counts-json")
    e = fx.transactions_events(spark, sf).groupBy(F.col("ip_address").alias("ip")).agg(
        F.count(F.lit(1)).alias("n"))
    files.sink_json(e, path)
    return finalize(spark.read.schema("ip string, n bigint").json(path))


# ------------------------------------------------------------ 2.2 projections / schema

# Reference-style headers for the transaction fixture.
RAW_HEADERS = {
    "transaction_id": "Transaction ID", "customer_id": "Customer ID",
    "transaction_amount": "Transaction Amount", "transaction_date": "Transaction Date",
    "payment_method": "Payment Method", "product_category": "Product Category", "quantity": "Quantity",
    "customer_age": "Customer Age", "customer_location": "Customer Location", "device_used": "Device Used",
    "ip_address": "IP Address", "shipping_address": "Shipping Address", "billing_address": "Billing Address",
    "account_age_days": "Account Age Days", "transaction_hour": "Transaction Hour",
    "is_fraudulent": "Is Fraudulent",
}


def raw_transactions(spark, sf):
    t = fx.transactions_orders(spark, sf).withColumn("transaction_id", F.col("transaction_id").cast("string"))
    return t.select(*[F.col(k).alias(v) for k, v in RAW_HEADERS.items()])


RENAMED = ["Transaction_ID", "customer_id", "transaction_amount", "transaction_date", "payment_method",
           "product_category", "Quantity", "customer_age", "customer_location", "device_used", "ip_address",
           "shipping_address", "billing_address", "account_age_days", "transaction_hour", "is_fraudulent"]


@register("rename_clean_headers", f"""
WITH {TXN_O_CTE}
SELECT CAST(transaction_id AS VARCHAR) AS Transaction_ID, customer_id, transaction_amount, transaction_date,
       payment_method, product_category, quantity AS Quantity, customer_age, customer_location, device_used,
       ip_address, shipping_address, billing_address, account_age_days, transaction_hour, is_fraudulent
FROM txn_o""")
def q_rename_clean_headers(spark, sf):
    out = schema.rename_clean_headers(raw_transactions(spark, sf))
    assert out.columns == RENAMED, out.columns
    return finalize(out)


@register("normalize_name", """
SELECT p_partkey,
       regexp_replace(regexp_replace(lower(regexp_replace(p_brand || ' - ' || p_name || '  ', '^\\s+|\\s+$', '', 'g')),
                      '[^0-9a-z]+', '_', 'g'), '^_+|_+$', '', 'g') AS name_norm
FROM part""")
def q_normalize_name(spark, sf):
    p = fx.table(spark, sf, "part")
    return p.select("p_partkey", fc.normalize_name_col(
        F.concat(F.col("p_brand"), F.lit(" - "), F.col("p_name"), F.lit("  "))).alias("name_norm"))


@register("rename_prefix", """
SELECT d.doc_id AS TransactionID, l.quality AS id_01, l.toxic AS id_02
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def q_rename_prefix(spark, sf):
    d, lab = fx.identity_tables(spark, sf)
    test_side = lab.withColumnsRenamed({"id_01": "id-01", "id_02": "id-02"})
    fixed = schema.rename_prefix(test_side, "id-", "id_")
    j = d.select("TransactionID").join(fixed, "TransactionID", "left")
    return finalize(j)


@register("common_columns", f"""
WITH {TXN_E_CTE}
SELECT transaction_id, customer_id, transaction_amount, transaction_hour, product_category, ip_address,
       is_fraudulent FROM txn_e""")
def q_common_columns(spark, sf):
    train = fx.transactions_orders(spark, sf)
    test = fx.transactions_events(spark, sf)
    cols = schema.common_columns(train, test)
    return finalize(schema.align_to(test, cols))


@register("drop_columns_if_present", f"""
WITH {TXN_O_CTE}
SELECT transaction_id, customer_id, transaction_amount, transaction_hour, payment_method, product_category,
       device_used, customer_location, quantity, customer_age, account_age_days, is_fraudulent FROM txn_o""")
def q_drop_columns_if_present(spark, sf):
    t = fx.transactions_orders(spark, sf).withColumn("Unnamed: 0", F.lit(0))
    out = schema.drop_columns_if_present(
        t, ["shipping_address", "billing_address", "transaction_date", "ip_address", "not_a_column"])
    return finalize(out)


@register("select_numeric", f"""
WITH {TXN_O_CTE}
SELECT transaction_id, customer_id, transaction_amount, transaction_hour, quantity, customer_age,
       account_age_days FROM txn_o""")
def q_select_numeric(spark, sf):
    return finalize(schema.select_numeric(fx.transactions_orders(spark, sf), "is_fraudulent"), money=("quantity",))


@register("detect_target", f"WITH {TXN_O_CTE} SELECT transaction_id, is_fraudulent AS target FROM txn_o")
def q_detect_target(spark, sf):
    t = fx.transactions_orders(spark, sf).withColumnRenamed("is_fraudulent", "Is Fraudulent")
    col = schema.detect_target(t)
    return finalize(t.select("transaction_id", F.col(f"`{col}`").alias("target")))


@register("detect_amount_column", f"""
WITH {TXN_O_CTE} SELECT CAST(transaction_id AS VARCHAR) AS id, transaction_amount AS amount FROM txn_o""")
def q_detect_amount_column(spark, sf):
    raw = raw_transactions(spark, sf)
    col = schema.detect_amount_column(raw)
    return finalize(raw.select(F.col("`Transaction ID`").alias("id"), F.col(f"`{col}`").alias("amount")),
                    money=("amount",))


@register("drop_target_like_columns", f"""
WITH {TXN_O_CTE}, lab AS (SELECT *, is_fraudulent AS label_copy FROM txn_o)
SELECT transaction_id, customer_id, transaction_amount, transaction_hour, quantity, customer_age,
       account_age_days FROM lab""")
def q_drop_target_like_columns(spark, sf):
    t = fx.transactions_orders(spark, sf).withColumn("label_copy", F.col("is_fraudulent"))
    names = schema.drop_target_like(schema.numeric_columns(t))
    return finalize(t.select(*names), money=("quantity",))


@register("filter_fraud", f"""
WITH {TXN_O_CTE} SELECT transaction_id, transaction_amount FROM txn_o WHERE is_fraudulent = 1""")
def q_filter_fraud(spark, sf):
    t = fx.transactions_orders(spark, sf)
    return finalize(t.where(F.col("is_fraudulent") == 1).select("transaction_id", "transaction_amount"))


@register("dropna_subset", f"""
WITH {TXN_O_CTE} SELECT transaction_id, quantity, transaction_amount FROM txn_o
WHERE quantity IS NOT NULL AND transaction_amount IS NOT NULL""")
def q_dropna_subset(spark, sf):
    t = fx.transactions_orders(spark, sf).select("transaction_id", "quantity", "transaction_amount")
    return finalize(t.na.drop(subset=["quantity", "transaction_amount"]))


@register("isin_filter_flag", f"""
WITH {TXN_E_CTE} SELECT transaction_id, CAST(product_category IN ('purchase', 'click') AS INTEGER) AS is_buy_flow
FROM txn_e""")
def q_isin_filter_flag(spark, sf):
    t = fx.transactions_events(spark, sf)
    return finalize(t.select("transaction_id",
                             F.col("product_category").isin("purchase", "click").cast("int").alias("is_buy_flow")))


# ------------------------------------------------------------ 2.3 cleaning


@register("normalize_key", f"""
WITH {TXN_O_CTE}
SELECT transaction_id, {norm_sql("'  ' || payment_method || chr(9)")} AS payment_method_norm,
       {norm_sql('product_category')} AS product_category_norm,
       {norm_sql("CASE WHEN transaction_id % 9 = 0 THEN NULL ELSE customer_location END")} AS customer_location_norm
FROM txn_o""")
def q_normalize_key(spark, sf):
    t = fx.transactions_orders(spark, sf).select(
        "transaction_id",
        F.concat(F.lit("  "), F.col("payment_method"), F.lit("\t")).alias("payment_method"),
        "product_category",
        F.when(F.pmod("transaction_id", F.lit(9)) != 0, F.col("customer_location")).alias("customer_location"))
    out = clean.normalize_keys(t, ["payment_method", "product_category", "customer_location"])
    return out.select("transaction_id", "payment_method_norm", "product_category_norm", "customer_location_norm")


@register("safe_int", """
SELECT event_id, CAST(trunc(coalesce(CASE WHEN isfinite(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE))
                                     THEN TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) END, 0)) AS BIGINT) AS k_int,
       CAST(trunc(coalesce(CASE WHEN isfinite(TRY_CAST(event_type AS DOUBLE)) THEN TRY_CAST(event_type AS DOUBLE) END, 0))
            AS BIGINT) AS type_int,
       CAST(trunc(coalesce(CASE WHEN isfinite(value / 7) THEN value / 7 END, 0)) AS BIGINT) AS value_int
FROM events""")
def q_safe_int(spark, sf):
    e = fx.table(spark, sf, "events")
    return finalize(e.select("event_id", fc.safe_int(F.get_json_object("props", "$.k")).alias("k_int"),
                             fc.safe_int("event_type").alias("type_int"),
                             fc.safe_int(F.col("value") / 7).alias("value_int")))


@register("to_numeric_coerce", """
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k_num,
       TRY_CAST(event_type AS DOUBLE) AS type_num FROM events""")
def q_to_numeric_coerce(spark, sf):
    e = fx.table(spark, sf, "events")
    return finalize(e.select("event_id", fc.to_numeric(F.get_json_object("props", "$.k")).alias("k_num"),
                             fc.to_numeric("event_type").alias("type_num")))


@register("to_datetime_coerce", """
SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 5 = 0 THEN 'not a date ' || o_orderkey
                                 ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP) AS order_ts
FROM orders""")
def q_to_datetime_coerce(spark, sf):
    o = fx.table(spark, sf, "orders")
    txt = F.when(F.pmod("o_orderkey", F.lit(5)) == 0, F.concat(F.lit("not a date "), F.col("o_orderkey")))\
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return o.select("o_orderkey", fc.to_datetime(txt).alias("order_ts"))


# Raw label spellings cycled over orders for the target-coercion query.
LABEL_SPELLINGS = ["Yes", " TRUE ", "0", "x", "no", "Y", "false", "1", "2.0", "n", "N/A"]


@register("coerce_binary_target", f"""
WITH raw AS (SELECT o_orderkey, ({LABEL_SPELLINGS})[CAST(o_orderkey % {len(LABEL_SPELLINGS)} AS INTEGER) + 1] AS label
             FROM orders),
s AS (SELECT o_orderkey, label, lower(regexp_replace(label, '^\\s+|\\s+$', '', 'g')) AS t FROM raw)
SELECT o_orderkey, label,
       CAST(CASE WHEN t IN ('1', 'true', 'yes', 'y') THEN 1 WHEN t IN ('0', 'false', 'no', 'n') THEN 0
            WHEN isfinite(TRY_CAST(t AS DOUBLE)) THEN CAST(trunc(TRY_CAST(t AS DOUBLE)) AS INTEGER)
            ELSE 0 END AS BIGINT) AS target
FROM s""")
def q_coerce_binary_target(spark, sf):
    o = fx.table(spark, sf, "orders")
    lab = F.element_at(F.array(*[F.lit(x) for x in LABEL_SPELLINGS]),
                       (F.pmod("o_orderkey", F.lit(len(LABEL_SPELLINGS))) + 1).cast("int"))
    t = o.select("o_orderkey", lab.alias("label"))
    return finalize(t.withColumn("target", fc.coerce_binary_target("label")))


@register("impute_median", f"""
WITH {TXN_O_CTE}
SELECT transaction_id, round(coalesce(quantity, (SELECT median(quantity) FROM txn_o)), 4) AS quantity,
       round(coalesce(transaction_amount, (SELECT median(transaction_amount) FROM txn_o)), 4) AS transaction_amount
FROM txn_o""")
def q_impute_median(spark, sf):
    t = fx.transactions_orders(spark, sf).select("transaction_id", "quantity", "transaction_amount")
    return finalize(clean.impute_median(t, ["quantity", "transaction_amount"]), digits=4)


@register("impute_constant", """
SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), 'Unknown') AS quality_cat,
       coalesce(CAST(l.toxic AS VARCHAR), 'missing') AS toxic_cat
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def q_impute_constant(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id")
    lab = fx.table(spark, sf, "labels").select(
        "doc_id", F.col("quality").cast("string").alias("quality_cat"), F.col("toxic").cast("string").alias("toxic_cat"))
    return clean.impute_constant(d.join(lab, "doc_id", "left"), {"quality_cat": "Unknown", "toxic_cat": "missing"})


@register("fill_zero_all", f"""
WITH {TXN_O_CTE}
SELECT transaction_id,
       round(CASE WHEN transaction_id % 11 = 0 THEN 0.0 WHEN transaction_id % 13 = 0 THEN 0.0
                  ELSE transaction_amount END, 4) AS amount_x,
       round(coalesce(quantity, 0), 4) AS quantity, payment_method FROM txn_o""")
def q_fill_zero_all(spark, sf):
    t = fx.transactions_orders(spark, sf)
    x = (F.when(F.pmod("transaction_id", F.lit(11)) == 0, F.lit(float("inf")))
          .when(F.pmod("transaction_id", F.lit(13)) == 0, F.lit(float("-inf")))
          .otherwise(F.col("transaction_amount")))
    t = t.select("transaction_id", x.alias("amount_x"), "quantity", "payment_method")
    return finalize(clean.fill_zero_all(t), digits=4)


@register("fill_by_column_kind", f"""
WITH {TXN_E_CTE}, cf_prod AS (
  SELECT c.c_mktsegment AS category, (c.c_acctbal < 0) AS is_counterfeit FROM customer c),
st AS (SELECT {norm_sql('category')} AS category_norm, avg(CAST(is_counterfeit AS DOUBLE)) AS r,
              count(is_counterfeit) AS n FROM cf_prod GROUP BY 1)
SELECT t.transaction_id, round(coalesce(st.r, 0.0), 6) AS cnt_prod_counterfeit_rate_cat,
       coalesce(st.n, 0) AS cnt_prod_count_cat
FROM txn_e t LEFT JOIN st ON {norm_sql('t.product_category')} = st.category_norm""")
def q_fill_by_column_kind(spark, sf):
    from ..operators.joins import enrich_left
    from .q_aggregates import category_rates
    t = fx.transactions_events(spark, sf).withColumn("category_norm", fc.normalize_key("product_category"))
    j = enrich_left(t, category_rates(spark, sf), ["category_norm"])
    j = clean.fill_by_column_kind(j, ["cnt_prod_counterfeit_rate_cat", "cnt_prod_count_cat", "absent_rate"])
    return finalize(j.select("transaction_id", "cnt_prod_counterfeit_rate_cat", "cnt_prod_count_cat"))


@register("dedup_keep_first", """
SELECT l_orderkey, l_linenumber, l_shipdate FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber) AS rn FROM lineitem)
WHERE rn = 1""")
def q_dedup_keep_first(spark, sf):
    li = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return finalize(clean.dedup_keep_first(li, "l_orderkey", ["l_shipdate", "l_linenumber"]))


@register("dedup_dropped", """
SELECT count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_kept, count(*) - count(DISTINCT l_orderkey) AS n_dropped
FROM lineitem""")
def q_dedup_dropped(spark, sf):
    """How many rows ``dedup_keep_first`` drops."""
    return finalize(clean.dedup_report(fx.table(spark, sf, "lineitem"), "l_orderkey"))


@register("coverage_report", """
SELECT count(*) AS n_rows, count(TRY_CAST(l_quantity AS DOUBLE)) AS n_valid_numeric,
       count(DISTINCT l_orderkey) AS n_distinct_keys, count(*) - count(DISTINCT l_orderkey) AS n_duplicates
FROM lineitem""")
def q_coverage_report(spark, sf):
    return finalize(clean.coverage_report(fx.table(spark, sf, "lineitem"), "l_quantity", "l_orderkey"))


# ------------------------------------------------------------ 2.9 scalar functions


@register("date_parts", f"""
WITH {TXN_O_CTE}
SELECT transaction_id, isodow(transaction_date) - 1 AS tx_dayofweek, day(transaction_date) AS tx_day,
       month(transaction_date) AS tx_month, strftime(transaction_date, '%Y-%m-%d') AS tx_date FROM txn_o""")
def q_date_parts(spark, sf):
    t = fx.transactions_orders(spark, sf)
    return finalize(t.select("transaction_id", ff.weekday("transaction_date").alias("tx_dayofweek"),
                             F.dayofmonth("transaction_date").alias("tx_day"),
                             F.month("transaction_date").alias("tx_month"),
                             F.date_format("transaction_date", "yyyy-MM-dd").alias("tx_date")))


@register("date_parts_dt", f"""
WITH {TXN_O_CTE}, d AS (SELECT transaction_id, transaction_date + to_hours(transaction_hour) AS dt FROM txn_o)
SELECT transaction_id, year(dt) AS tx_year, month(dt) AS tx_month, isodow(dt) - 1 AS tx_dow,
       hour(dt) AS tx_hour_of_day, CAST(isodow(dt) - 1 >= 5 AS INTEGER) AS is_weekend FROM d""")
def q_date_parts_dt(spark, sf):
    t = fx.transactions_orders(spark, sf).withColumn("dt", ff.date_plus_hours("transaction_date", "transaction_hour"))
    return finalize(t.select("transaction_id", F.year("dt").alias("tx_year"), F.month("dt").alias("tx_month"),
                             ff.weekday("dt").alias("tx_dow"), F.hour("dt").alias("tx_hour_of_day"),
                             ff.is_weekend(ff.weekday("dt")).alias("is_weekend")))


@register("day_name_hour", f"""
WITH {TXN_E_CTE} SELECT transaction_id, dayname(transaction_ts) AS dow, hour(transaction_ts) AS hour FROM txn_e""")
def q_day_name_hour(spark, sf):
    t = fx.transactions_events(spark, sf)
    return finalize(t.select("transaction_id", ff.day_name("transaction_ts").alias("dow"),
                             F.hour("transaction_ts").alias("hour")))


@register("date_plus_hours", f"""
WITH {TXN_O_CTE} SELECT transaction_id, transaction_date + to_hours(transaction_hour) AS transaction_datetime
FROM txn_o""")
def q_date_plus_hours(spark, sf):
    t = fx.transactions_orders(spark, sf)
    return t.select("transaction_id",
                    ff.date_plus_hours("transaction_date", "transaction_hour").alias("transaction_datetime"))


@register("is_weekend", f"""
WITH {TXN_E_CTE} SELECT transaction_id, CAST(isodow(transaction_ts) - 1 IN (5, 6) AS INTEGER) AS is_weekend
FROM txn_e""")
def q_is_weekend(spark, sf):
    t = fx.transactions_events(spark, sf)
    return finalize(t.select("transaction_id", ff.is_weekend(ff.weekday("transaction_ts")).alias("is_weekend")))


def _hour_sql(h: str) -> str:
    return f"least(greatest(CAST(trunc(coalesce({h}, -1)) AS INTEGER), 0), 23)"


@register("hour_cyclic", f"""
WITH {TXN_O_CTE}, h AS (
  SELECT transaction_id, CASE WHEN transaction_id % 17 = 0 THEN NULL
                              WHEN transaction_id % 19 = 0 THEN transaction_hour + 10
                              ELSE transaction_hour END AS hr FROM txn_o)
SELECT transaction_id, round(sin(2 * pi() * {_hour_sql('hr')} / 24.0), 6) AS hour_sin,
       round(cos(2 * pi() * {_hour_sql('hr')} / 24.0), 6) AS hour_cos,
       CAST({_hour_sql('hr')} <= 6 OR {_hour_sql('hr')} >= 22 AS INTEGER) AS is_night FROM h""")
def q_hour_cyclic(spark, sf):
    t = fx.transactions_orders(spark, sf)
    hr = (F.when(F.pmod("transaction_id", F.lit(17)) == 0, F.lit(None).cast("int"))
           .when(F.pmod("transaction_id", F.lit(19)) == 0, F.col("transaction_hour") + 10)
           .otherwise(F.col("transaction_hour")))
    t = t.select("transaction_id", hr.alias("hr"))
    return finalize(t.select("transaction_id", ff.hour_sin("hr").alias("hour_sin"),
                             ff.hour_cos("hr").alias("hour_cos"), ff.is_night("hr").alias("is_night")))


@register("log_amount", f"""
WITH {TXN_E_CTE} SELECT transaction_id, round(ln(1 + greatest(transaction_amount - 5, 0)), 6) AS log_amount,
  round(CASE WHEN transaction_amount - 5 > -1 THEN ln(1 + (transaction_amount - 5)) END, 6) AS log_amount_raw
FROM txn_e""")
def q_log_amount(spark, sf):
    t = fx.transactions_events(spark, sf).withColumn("a", F.col("transaction_amount") - 5)
    return finalize(t.select("transaction_id", ff.log_amount("a").alias("log_amount"),
                             F.when(F.col("a") > -1, ff.log_amount("a", clip_at_zero=False)).alias("log_amount_raw")))


@register("is_high_amount", f"""
WITH {TXN_O_CTE}, q AS (SELECT quantile_cont(transaction_amount, 0.95) AS th FROM txn_o)
SELECT transaction_id, CAST(transaction_amount >= q.th AS INTEGER) AS is_high_amount FROM txn_o CROSS JOIN q""")
def q_is_high_amount(spark, sf):
    from ..operators.joins import cross_join_scalar
    t = fx.transactions_orders(spark, sf)
    th = exact_quantiles(t, "transaction_amount", [0.95], names=["th"])
    j = cross_join_scalar(t, th)
    return finalize(j.select("transaction_id", ff.is_high_amount("transaction_amount", "th").alias("is_high_amount")))


@register("amount_per_unit", f"""
WITH {TXN_O_CTE}, q AS (SELECT *, CASE WHEN transaction_id % 10 = 0 THEN 0 ELSE quantity END AS qty FROM txn_o)
SELECT transaction_id, coalesce(CASE WHEN qty <> 0 THEN transaction_amount / qty END, transaction_amount)
       AS amount_per_unit FROM q""")
def q_amount_per_unit(spark, sf):
    t = fx.transactions_orders(spark, sf)
    qty = F.when(F.pmod("transaction_id", F.lit(10)) == 0, F.lit(0.0)).otherwise(F.col("quantity"))
    return finalize(t.select("transaction_id", ff.amount_per_unit("transaction_amount", qty).alias("amount_per_unit")),
                    digits=None)


def _bins_sql(x: str, edges: list, include_lowest: bool) -> str:
    parts = []
    for i in range(len(edges) - 1):
        lo_op = ">=" if include_lowest and i == 0 else ">"
        parts.append(f"WHEN {x} {lo_op} {edges[i]} AND {x} <= {edges[i + 1]} THEN {i}")
    return "CASE " + " ".join(parts) + " ELSE -1 END"


@register("account_age_bucket", f"""
WITH {TXN_O_CTE}, a AS (SELECT transaction_id, CAST(account_age_days AS DOUBLE) - 200 AS d FROM txn_o)
SELECT transaction_id, {_bins_sql('d', ff.ACCOUNT_AGE_EDGES, False)} AS account_age_bucket FROM a""")
def q_account_age_bucket(spark, sf):
    t = fx.transactions_orders(spark, sf).select("transaction_id", (F.col("account_age_days") - 200).alias("d"))
    return finalize(t.select("transaction_id", ff.account_age_bucket("d").alias("account_age_bucket")))


@register("customer_age_bucket", f"""
WITH {TXN_O_CTE}, a AS (SELECT transaction_id, CAST(customer_age AS DOUBLE) * 1.5 - 10 AS age FROM txn_o)
SELECT transaction_id, {_bins_sql('age', ff.CUSTOMER_AGE_EDGES, True)} AS customer_age_bucket FROM a""")
def q_customer_age_bucket(spark, sf):
    t = fx.transactions_orders(spark, sf).select("transaction_id", (F.col("customer_age") * 1.5 - 10).alias("age"))
    return finalize(t.select("transaction_id", ff.customer_age_bucket("age").alias("customer_age_bucket")))


@register("address_match", f"""
WITH {TXN_O_CTE} SELECT transaction_id, CAST(coalesce(shipping_address = billing_address, false) AS INTEGER)
  AS address_match FROM txn_o""")
def q_address_match(spark, sf):
    t = fx.transactions_orders(spark, sf)
    return finalize(t.select("transaction_id",
                             ff.address_match("shipping_address", "billing_address").alias("address_match")))


# TPC-H domains of the three one-hot encoded fixture columns.
ONE_HOT_LEVELS = {
    ("payment_method", "PM"): ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
    ("device_used", "Device"): ["F", "O", "P"],
    ("product_category", "Product"): ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
}


def _one_hot_sql() -> str:
    cols = ",\n       ".join(f"CAST(coalesce({c} = '{v}', false) AS BIGINT) AS \"{p}_{v}\""
                             for (c, p), levels in ONE_HOT_LEVELS.items() for v in levels)
    return f"WITH {TXN_O_CTE}\nSELECT transaction_id, is_fraudulent,\n       {cols}\nFROM txn_o"


@register("one_hot", _one_hot_sql())
def q_one_hot(spark, sf):
    t = fx.transactions_orders(spark, sf).select("transaction_id", "payment_method", "device_used",
                                                 "product_category", "is_fraudulent")
    return finalize(encoders.one_hot(t, ["payment_method", "device_used", "product_category"],
                                     ["PM", "Device", "Product"]))


@register("label_encode", f"""
WITH {TXN_O_CTE}, lv AS (SELECT payment_method, row_number() OVER (ORDER BY payment_method) - 1 AS payment_method_code
                        FROM (SELECT DISTINCT payment_method FROM txn_o WHERE payment_method IS NOT NULL))
SELECT t.transaction_id, lv.payment_method_code FROM txn_o t LEFT JOIN lv ON t.payment_method = lv.payment_method""")
def q_label_encode(spark, sf):
    t = fx.transactions_orders(spark, sf).select("transaction_id", "payment_method")
    return finalize(encoders.label_encode(t, "payment_method").select("transaction_id", "payment_method_code"))


@register("label_text", f"""
WITH {TXN_O_CTE} SELECT transaction_id, CASE WHEN is_fraudulent = 1 THEN 'Fraud' WHEN is_fraudulent = 0 THEN 'Legit'
  ELSE CAST(is_fraudulent AS VARCHAR) END AS fraud_label FROM txn_o""")
def q_label_text(spark, sf):
    t = fx.transactions_orders(spark, sf)
    return t.select("transaction_id", fc.label_text("is_fraudulent").alias("fraud_label"))


@register("price_deviation", f"""
WITH {LISTINGS_CTE} SELECT transaction_id,
  round(CASE WHEN original_price <> 0 THEN (product_price - original_price) / original_price END, 6) AS price_deviation
FROM listings""")
def q_price_deviation(spark, sf):
    lst = fx.listings(spark, sf)
    return finalize(lst.select("transaction_id", ff.price_deviation("product_price", "original_price")
                               .alias("price_deviation")))


@register("seller_credibility", f"""
WITH {LISTINGS_CTE} SELECT transaction_id,
  round((seller_rating / 5.0) * 0.3 + (seller_response_rate / 100.0) * 0.2
        + (least(seller_age_days / 365.0, 5.0) / 5.0) * 0.3 + CAST(is_top_rated_seller AS INTEGER) * 0.2, 6)
  AS seller_credibility_score FROM listings""")
def q_seller_credibility(spark, sf):
    lst = fx.listings(spark, sf)
    return finalize(lst.select("transaction_id", ff.seller_credibility(
        "seller_rating", "seller_response_rate", "seller_age_days", "is_top_rated_seller")
        .alias("seller_credibility_score")))


@register("product_credibility", f"""
WITH {LISTINGS_CTE} SELECT transaction_id,
  round((product_rating / 5.0) * 0.4 + (least(reviews_count / 100.0, 10.0) / 10.0) * 0.3
        + (least(sold_count / 1000.0, 10.0) / 10.0) * 0.3, 6) AS product_credibility_score FROM listings""")
def q_product_credibility(spark, sf):
    lst = fx.listings(spark, sf)
    return finalize(lst.select("transaction_id", ff.product_credibility("product_rating", "reviews_count", "sold_count")
                               .alias("product_credibility_score")))


@register("risk_flags", f"""
WITH {LISTINGS_CTE} SELECT transaction_id, discount_percentage > 70 AS high_discount_flag,
  seller_rating < 4.0 AS low_seller_rating_flag, seller_age_days < 90 AS new_seller_flag,
  reviews_count < 10 AS low_reviews_flag, item_location IN ('China', 'Hong Kong', 'Overseas') AS risky_location_flag
FROM listings""")
def q_risk_flags(spark, sf):
    lst = fx.listings(spark, sf)
    return lst.select("transaction_id", *[c.alias(n) for n, c in ff.risk_flags().items()])


@register("fraud_risk_score", f"""
WITH {LISTINGS_CTE},
q AS (SELECT product_category, quantile_cont(product_price, 0.15) AS lo FROM listings GROUP BY 1),
f AS (SELECT l.*, coalesce(l.product_price < q.lo, false) AS is_too_cheap FROM listings l
      LEFT JOIN q ON l.product_category = q.product_category)
SELECT transaction_id, CAST(greatest(
    CAST(discount_percentage > 70 AS INTEGER) * 3 + CAST(is_too_cheap AS INTEGER) * 3
  + CAST(seller_rating < 4.0 AS INTEGER) * 2 + CAST(seller_age_days < 90 AS INTEGER) * 2
  + CAST(reviews_count < 10 AS INTEGER) * 1
  + CAST(item_location IN ('China', 'Hong Kong', 'Overseas') AS INTEGER) * 2
  + (1 - CAST(has_return_policy AS INTEGER)) * 1 + (1 - CAST(is_verified AS INTEGER)) * 2
  - CAST(is_official_store AS INTEGER) * 3, 0) AS BIGINT) AS fraud_risk_score
FROM f""")
def q_fraud_risk_score(spark, sf):
    from ..operators.aggregates import group_quantile_flags
    lst = group_quantile_flags(fx.listings(spark, sf), "product_category", "product_price")
    lst = lst.withColumns(ff.risk_flags())
    score = ff.fraud_risk_score("high_discount_flag", "is_too_cheap", "low_seller_rating_flag", "new_seller_flag",
                                "low_reviews_flag", "risky_location_flag", "has_return_policy", "is_verified",
                                "is_official_store")
    return finalize(lst.select("transaction_id", score.alias("fraud_risk_score")))


# Request-style transactions for the rule score: payment / device spellings
# of the scoring API cycled over orders.
REQ_PAYMENTS = ["Credit Card", "PayPal", "Debit Card", "Bank Transfer"]
REQ_DEVICES = ["Mobile", "Desktop", "Tablet"]


def rule_requests(spark, sf):
    t = fx.transactions_orders(spark, sf)
    pay = F.element_at(F.array(*[F.lit(x) for x in REQ_PAYMENTS]),
                       (F.pmod("transaction_id", F.lit(len(REQ_PAYMENTS))) + 1).cast("int"))
    dev = F.element_at(F.array(*[F.lit(x) for x in REQ_DEVICES]),
                       (F.pmod("transaction_id", F.lit(len(REQ_DEVICES))) + 1).cast("int"))
    bill = F.when(F.pmod("transaction_id", F.lit(5)) == 0, F.lit(None).cast("string")) \
        .when(F.pmod("transaction_id", F.lit(5)) == 1, F.lit("")).otherwise(F.col("billing_address"))
    return t.select("transaction_id", (F.col("transaction_amount") / 100).alias("amount"), pay.alias("payment_method"),
                    dev.alias("device"), F.col("shipping_address").alias("shipping"), bill.alias("billing"),
                    (F.pmod("transaction_id", F.lit(50)).cast("double")).alias("base_pct"))


RULE_REQ_SQL = f"""
WITH {TXN_O_CTE}, req AS (
  SELECT transaction_id, transaction_amount / 100 AS amount,
         ({REQ_PAYMENTS})[CAST(transaction_id % {len(REQ_PAYMENTS)} AS INTEGER) + 1] AS payment_method,
         ({REQ_DEVICES})[CAST(transaction_id % {len(REQ_DEVICES)} AS INTEGER) + 1] AS device,
         shipping_address AS shipping,
         CASE WHEN transaction_id % 5 = 0 THEN NULL WHEN transaction_id % 5 = 1 THEN '' ELSE billing_address END
           AS billing,
         CAST(transaction_id % 50 AS DOUBLE) AS base_pct FROM txn_o),
pts AS (SELECT *, (CASE WHEN amount > 500 THEN 30 ELSE 0 END) + (CASE WHEN amount > 2000 THEN 20 ELSE 0 END)
        + (CASE WHEN payment_method IN ('Credit Card', 'PayPal') THEN 10 ELSE 0 END)
        + (CASE WHEN billing IS NOT NULL AND billing <> '' AND NOT coalesce(billing = shipping, false) THEN 20 ELSE 0 END)
        + (CASE WHEN device = 'Mobile' THEN 10 ELSE 0 END) AS risk_points FROM req)"""


@register("rule_points", RULE_REQ_SQL + "\nSELECT transaction_id, CAST(risk_points AS BIGINT) AS risk_points FROM pts")
def q_rule_points(spark, sf):
    r = rule_requests(spark, sf)
    return finalize(r.select("transaction_id", ff.rule_points("amount", "payment_method", "billing", "shipping", "device")
                             .alias("risk_points")))


@register("risk_level_tx", RULE_REQ_SQL + """
, fin AS (SELECT transaction_id, round(least(100.0, base_pct + risk_points), 2) AS fraud_probability FROM pts)
SELECT transaction_id, fraud_probability,
       CASE WHEN fraud_probability > 75 THEN 'High' WHEN fraud_probability > 40 THEN 'Medium' ELSE 'Low' END
         AS risk_level FROM fin""")
def q_risk_level_tx(spark, sf):
    r = rule_requests(spark, sf)
    pts = ff.rule_points("amount", "payment_method", "billing", "shipping", "device")
    out = r.select("transaction_id", ff.tx_final_probability("base_pct", pts).alias("fraud_probability"))
    return finalize(out.withColumn("risk_level", ff.risk_level("fraud_probability", 75, 40)), digits=2)


@register("risk_level_user", f"""
WITH {TXN_E_CTE}, s AS (SELECT transaction_id, least(transaction_amount / 500.0, 1.0) * 100 AS p FROM txn_e)
SELECT transaction_id, round(p, 2) AS fraud_probability,
       CASE WHEN p > 70 THEN 'High' WHEN p > 40 THEN 'Medium' ELSE 'Low' END AS risk_level FROM s""")
def q_risk_level_user(spark, sf):
    t = fx.transactions_events(spark, sf)
    p = F.least(F.col("transaction_amount") / 500.0, F.lit(1.0)) * 100
    out = t.select("transaction_id", p.alias("p"))
    return finalize(out.select("transaction_id", F.round("p", 2).alias("fraud_probability"),
                               ff.risk_level("p", 70, 40).alias("risk_level")), digits=2)


@register("stream_risk_level_tx", RULE_REQ_SQL + """
, fin AS (SELECT transaction_id, round(least(100.0, base_pct + risk_points), 2) AS fraud_probability FROM pts)
SELECT transaction_id, fraud_probability,
       CASE WHEN fraud_probability > 75 THEN 'High' WHEN fraud_probability > 40 THEN 'Medium' ELSE 'Low' END
         AS risk_level FROM fin""")
def q_stream_risk_level_tx(spark, sf):
    """The rule scoring of ``risk_level_tx`` run as a Structured Streaming job:
    requests are staged as parquet files, read with ``readStream`` and
    scored into an exactly-once parquet sink (available-now trigger)."""
    from ..streaming.scoring import rule_score, score_directory_once
    req = rule_requests(spark, sf)
    src = files.scratch_path(spark, "stream-requests")
    req.write.mode("overwrite").parquet(src)
    out = score_directory_once(spark, src, req.schema, rule_score)
    return finalize(out, digits=2)

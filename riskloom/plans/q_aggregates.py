"""Registered queries: rate tables and dashboard aggregates."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.cleaning import normalize_key
from ..functions.features import risk_flags
from ..operators import aggregates as agg
from ..operators.joins import country_to_iso3, ip_range_join
from ..operators.quantiles import exact_quantiles
from ..sources import fixtures as fx
from .common import (CF_PROD_CTE, CF_TXN_CTE, LISTINGS_CTE, RANGES_CTE, TXN_E_CTE, TXN_O_CTE, finalize,
                     norm_sql, register)

# ------------------------------------------------------------ 2.5 #43-#44


@register("kpi_totals", f"""
WITH {TXN_O_CTE}
SELECT count(*) AS total_tx,
       CAST(count(*) FILTER (WHERE is_fraudulent = 1) AS BIGINT) AS total_fraud,
       round(count(*) FILTER (WHERE is_fraudulent = 1) / greatest(count(*), 1), 6) AS fraud_rate,
       round(avg(transaction_amount), 4) AS avg_amount
FROM txn_o""")
def q_kpi_totals(spark, sf):
    return finalize(agg.kpi_totals(fx.transactions_orders(spark, sf)), money=("avg_amount",))


@register("class_counts", f"""
WITH {TXN_O_CTE}
SELECT CAST(is_fraudulent AS VARCHAR) AS class, count(*) AS count FROM txn_o GROUP BY 1""")
def q_class_counts(spark, sf):
    return finalize(agg.class_counts(fx.transactions_orders(spark, sf)))


# ------------------------------------------------------------ 2.5 #45-#48 side-table rates


def payment_rates(spark, sf, partials=None):
    parts = (partials if partials is not None else fx.counterfeit_transaction_partials(spark, sf)).withColumn(
        "payment_method_norm", normalize_key("payment_method"))
    return agg.rate_stats(parts, ["payment_method_norm"], None, "cnt_txn_counterfeit_rate_pm",
                          "cnt_txn_count_pm", n_col="n", pos_col="n_flagged")


def location_payment_rates(spark, sf, partials=None):
    parts = (partials if partials is not None else fx.counterfeit_transaction_partials(spark, sf)).withColumns({
        "customer_location_norm": normalize_key("customer_location"),
        "payment_method_norm": normalize_key("payment_method")})
    return agg.rate_stats(parts, ["customer_location_norm", "payment_method_norm"], None,
                          "cnt_txn_counterfeit_rate_loc_pm", "cnt_txn_count_loc_pm", n_col="n", pos_col="n_flagged")


def category_rates(spark, sf):
    prod = fx.counterfeit_products(spark, sf).withColumn("category_norm", normalize_key("category"))
    return agg.rate_stats(prod, ["category_norm"], "is_counterfeit", "cnt_prod_counterfeit_rate_cat",
                          "cnt_prod_count_cat")


def category_origin_rates(spark, sf):
    prod = fx.counterfeit_products(spark, sf).withColumns({
        "category_norm": normalize_key("category"), "shipping_origin_norm": normalize_key("shipping_origin")})
    return agg.rate_stats(prod, ["category_norm", "shipping_origin_norm"], "is_counterfeit",
                          "cnt_prod_counterfeit_rate_cat_org", "cnt_prod_count_cat_org")


@register("rate_by_payment", f"""
WITH {CF_TXN_CTE}
SELECT {norm_sql('payment_method')} AS payment_method_norm,
       round(avg(CAST(involves_counterfeit AS DOUBLE)), 6) AS cnt_txn_counterfeit_rate_pm,
       count(involves_counterfeit) AS cnt_txn_count_pm
FROM cf_txn GROUP BY 1""")
def q_rate_by_payment(spark, sf):
    return finalize(payment_rates(spark, sf))


@register("rate_by_location_payment", f"""
WITH {CF_TXN_CTE}
SELECT {norm_sql('customer_location')} AS customer_location_norm, {norm_sql('payment_method')} AS payment_method_norm,
       round(avg(CAST(involves_counterfeit AS DOUBLE)), 6) AS cnt_txn_counterfeit_rate_loc_pm,
       count(involves_counterfeit) AS cnt_txn_count_loc_pm
FROM cf_txn GROUP BY 1, 2""")
def q_rate_by_location_payment(spark, sf):
    return finalize(location_payment_rates(spark, sf))


@register("rate_by_category", f"""
WITH {CF_PROD_CTE}
SELECT {norm_sql('category')} AS category_norm,
       round(avg(CAST(is_counterfeit AS DOUBLE)), 6) AS cnt_prod_counterfeit_rate_cat,
       count(is_counterfeit) AS cnt_prod_count_cat
FROM cf_prod GROUP BY 1""")
def q_rate_by_category(spark, sf):
    return finalize(category_rates(spark, sf))


@register("rate_by_category_origin", f"""
WITH {CF_PROD_CTE}
SELECT {norm_sql('category')} AS category_norm, {norm_sql('shipping_origin')} AS shipping_origin_norm,
       round(avg(CAST(is_counterfeit AS DOUBLE)), 6) AS cnt_prod_counterfeit_rate_cat_org,
       count(is_counterfeit) AS cnt_prod_count_cat_org
FROM cf_prod GROUP BY 1, 2""")
def q_rate_by_category_origin(spark, sf):
    return finalize(category_origin_rates(spark, sf))


# ------------------------------------------------------------ 2.5 #49-#52 dashboard


@register("fraud_rate_by_payment_method", f"""
WITH {TXN_O_CTE}
SELECT payment_method, round(avg(CAST(is_fraudulent AS DOUBLE)) * 100, 6) AS fraud_rate
FROM txn_o WHERE payment_method IS NOT NULL GROUP BY 1""")
def q_fraud_rate_by_payment_method(spark, sf):
    return finalize(agg.fraud_rate_by(fx.transactions_orders(spark, sf), "payment_method"))


@register("fraud_rate_by_device", f"""
WITH {TXN_O_CTE}
SELECT device_used, round(avg(CAST(is_fraudulent AS DOUBLE)) * 100, 6) AS fraud_rate
FROM txn_o WHERE device_used IS NOT NULL GROUP BY 1""")
def q_fraud_rate_by_device(spark, sf):
    return finalize(agg.fraud_rate_by(fx.transactions_orders(spark, sf), "device_used"))


@register("fraud_top_categories", f"""
WITH {TXN_E_CTE}
SELECT product_category, count(*) AS fraud_count FROM txn_e
WHERE is_fraudulent = 1 AND product_category IS NOT NULL
GROUP BY 1 ORDER BY fraud_count DESC, product_category LIMIT 20""")
def q_fraud_top_categories(spark, sf):
    return finalize(agg.top_fraud_categories(fx.transactions_events(spark, sf), "product_category"))


@register("fraud_age_distribution", f"""
WITH {TXN_O_CTE}
SELECT customer_age, count(*) AS fraud_count FROM txn_o
WHERE is_fraudulent = 1 AND customer_age IS NOT NULL GROUP BY 1""")
def q_fraud_age_distribution(spark, sf):
    return finalize(agg.fraud_count_by(fx.transactions_orders(spark, sf), "customer_age"))


# ------------------------------------------------------------ 2.5 #53-#54 geo


# Fixed values, independent of the locale data that the operator reads: ISO 3166-1 alpha-3 codes of the fixture's
# countries under the names and spellings that occur in it.
EXPECTED_ISO3 = {
    "algeria": "DZA", "argentina": "ARG", "brazil": "BRA", "canada": "CAN", "china": "CHN", "egypt": "EGY",
    "ethiopia": "ETH", "france": "FRA", "germany": "DEU", "india": "IND", "indonesia": "IDN", "iran": "IRN",
    "iraq": "IRQ", "japan": "JPN", "jordan": "JOR", "kenya": "KEN", "morocco": "MAR", "mozambique": "MOZ",
    "peru": "PER", "romania": "ROU", "russia": "RUS", "russian federation": "RUS", "saudi arabia": "SAU",
    "u.s.": "USA", "united states": "USA", "united kingdom": "GBR", "vietnam": "VNM", "viet nam": "VNM",
}


def _country_values_sql() -> str:
    vals = ", ".join(f"('{k}', '{v}')" for k, v in EXPECTED_ISO3.items())
    return f"countries(name_lower, iso3) AS (VALUES {vals})"


def events_with_geo(spark, sf):
    e = fx.transactions_events(spark, sf)
    return ip_range_join(e, "ip_number", fx.ip_ranges(spark, sf))


@register("fraud_by_country", f"""
WITH {TXN_E_CTE}, {RANGES_CTE}, {_country_values_sql()},
geo AS (SELECT t.*, r.country FROM txn_e t LEFT JOIN ip_ranges r ON t.ip_number BETWEEN r.ip_lo AND r.ip_hi),
iso AS (
  SELECT g.*, c.iso3 FROM geo g LEFT JOIN countries c
    ON c.name_lower = CASE WHEN lower(trim(g.country)) IN ('unknown', 'local network', 'nan', '') THEN NULL
                           ELSE lower(trim(g.country)) END)
SELECT iso3, count(*) AS fraud_count FROM iso WHERE is_fraudulent = 1 AND iso3 IS NOT NULL GROUP BY 1""")
def q_fraud_by_country(spark, sf):
    g = country_to_iso3(events_with_geo(spark, sf), "country")
    return finalize(agg.fraud_count_by(g, "iso3"))


@register("geo_heat_cells", f"""
WITH {TXN_E_CTE}, {RANGES_CTE},
geo AS (SELECT t.*, r.lat, r.lon FROM txn_e t LEFT JOIN ip_ranges r ON t.ip_number BETWEEN r.ip_lo AND r.ip_hi)
SELECT round(lat, 1) AS lat_cell, round(lon, 1) AS lon_cell, count(*) AS count FROM geo
WHERE is_fraudulent = 1 AND lat IS NOT NULL AND lon IS NOT NULL GROUP BY 1, 2""")
def q_geo_heat_cells(spark, sf):
    g = events_with_geo(spark, sf).where(F.col("is_fraudulent") == 1)
    return finalize(agg.geo_heat_cells(g))


@register("geo_heat_centre", f"""
WITH {TXN_E_CTE}, {RANGES_CTE},
geo AS (SELECT t.*, r.lat, r.lon FROM txn_e t LEFT JOIN ip_ranges r ON t.ip_number BETWEEN r.ip_lo AND r.ip_hi)
SELECT round(avg(lat), 6) AS centre_lat, round(avg(lon), 6) AS centre_lon FROM geo WHERE is_fraudulent = 1""")
def q_geo_heat_centre(spark, sf):
    g = events_with_geo(spark, sf).where(F.col("is_fraudulent") == 1)
    return finalize(agg.geo_centre(g))


@register("geo_heat_pyramid", f"""
WITH {TXN_E_CTE}, {RANGES_CTE},
geo AS (SELECT r.lat, r.lon FROM txn_e t JOIN ip_ranges r ON t.ip_number BETWEEN r.ip_lo AND r.ip_hi
        WHERE t.is_fraudulent = 1),
tiles AS (SELECT z.zoom, lat, lon, CAST(floor((lon + 180.0) / 360.0 * pow(2, z.zoom)) AS BIGINT) AS x,
                 CAST(floor((1.0 - ln(tan(radians(lat)) + 1.0 / cos(radians(lat))) / pi()) / 2.0 * pow(2, z.zoom)) AS BIGINT)
                   AS y FROM geo, range(13) z(zoom))
SELECT zoom, array_to_string(list_transform(range(1, zoom + 1), lambda i:
           ((x >> (zoom - i)) & 1) + 2 * ((y >> (zoom - i)) & 1)), '') AS quadkey,
       count(*) AS count, round(avg(lat), 6) AS mean_lat, round(avg(lon), 6) AS mean_lon
FROM tiles GROUP BY zoom, x, y""")
def q_geo_heat_pyramid(spark, sf):
    g = events_with_geo(spark, sf).where(F.col("is_fraudulent") == 1)
    return finalize(agg.geo_heat_pyramid(g))


# ------------------------------------------------------------ 2.5 #55-#56, #73 time


def _matrix_sql() -> str:
    days = ", ".join(f"({i}, '{d}')" for i, d in enumerate(agg.DAY_NAMES))
    hours = ",\n       ".join(
        f"CAST(coalesce(sum(CASE WHEN f.hour = {h} THEN 1 ELSE 0 END), 0) AS BIGINT) AS h{h:02d}"
        for h in range(24))
    return f"""
WITH {TXN_E_CTE}, days(dow_idx, dow) AS (VALUES {days}),
f AS (SELECT dayname(transaction_ts) AS dow, hour(transaction_ts) AS hour FROM txn_e WHERE is_fraudulent = 1)
SELECT d.dow_idx, d.dow,
       {hours}
FROM days d LEFT JOIN f ON d.dow = f.dow GROUP BY d.dow_idx, d.dow"""


@register("fraud_hour_dow_matrix", _matrix_sql())
def q_fraud_hour_dow_matrix(spark, sf):
    return finalize(agg.hour_dow_matrix(fx.transactions_events(spark, sf), "transaction_ts"))


DAILY_SQL = f"""
WITH {TXN_E_CTE},
daily AS (SELECT CAST(transaction_ts AS DATE) AS day, count(transaction_id) AS transactions,
                 sum(is_fraudulent) AS frauds FROM txn_e GROUP BY 1),
cal AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM daily),
series AS (
  SELECT strftime(c.day, '%Y-%m-%d') AS day, CAST(coalesce(d.transactions, 0) AS BIGINT) AS transactions,
         CAST(coalesce(d.frauds, 0) AS BIGINT) AS frauds
  FROM cal c LEFT JOIN daily d ON c.day = d.day)"""


@register("daily_fraud_series", DAILY_SQL + """
SELECT day, transactions, frauds,
       round(100.0 * frauds / CASE WHEN transactions = 0 THEN 1 ELSE transactions END, 6) AS fraud_rate
FROM series""")
def q_daily_fraud_series(spark, sf):
    return finalize(agg.daily_series(fx.transactions_events(spark, sf), "transaction_ts"))


@register("stream_daily_series", DAILY_SQL + """
SELECT day, transactions, frauds,
       round(100.0 * frauds / CASE WHEN transactions = 0 THEN 1 ELSE transactions END, 6) AS fraud_rate
FROM series""")
def q_stream_daily_series(spark, sf):
    """The same kept up to date by a stream over event files, late ones included."""
    from ..sources import files
    from ..streaming import daily
    e = fx.transactions_events(spark, sf).select("transaction_id", "transaction_ts", "is_fraudulent")
    src, folder, checkpoint = (files.scratch_path(spark, f"daily-{n}") for n in ("events", "deltas", "checkpoint"))
    e.repartition(8).write.parquet(src)
    daily.start_daily(spark, src, e.schema, folder, checkpoint, max_files_per_trigger=3).awaitTermination()
    return finalize(daily.daily_series(spark, folder))


@register("daily_ma7", DAILY_SQL + """
SELECT day, transactions, frauds,
       round(100.0 * frauds / CASE WHEN transactions = 0 THEN 1 ELSE transactions END, 6) AS fraud_rate,
       round(CASE WHEN count(*) OVER w >= 7 THEN avg(transactions) OVER w END, 6) AS transactions_ma7,
       round(CASE WHEN count(*) OVER w >= 7 THEN avg(frauds) OVER w END, 6) AS frauds_ma7
FROM series WINDOW w AS (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def q_daily_ma7(spark, sf):
    return finalize(agg.daily_ma7(agg.daily_series(fx.transactions_events(spark, sf), "transaction_ts")))


# ------------------------------------------------------------ 2.5 #57-#59 histograms


def _hist_sql(cte: str, table: str, expr: str, maxbins: int, by: str | None = None) -> str:
    by_sel = f", {by}" if by else ""
    return f"""
WITH {cte},
base AS (SELECT CAST({expr} AS DOUBLE) AS x{by_sel} FROM {table}),
b AS (SELECT * FROM base WHERE x IS NOT NULL AND NOT isnan(x)),
mm AS (SELECT min(x) AS mn, max(x) AS mx, max(x) - min(x) AS span FROM b),
s0 AS (SELECT *, pow(10.0, floor(log10(span) + 0.5) - {math.ceil(math.log10(maxbins))}) AS st00 FROM mm),
s0a AS (SELECT *, CASE WHEN ceil(span / st00) > {maxbins} THEN st00 * 10 ELSE st00 END AS st0 FROM s0),
s0b AS (SELECT *, CASE WHEN ceil(span / st0) > {maxbins} THEN st0 * 10 ELSE st0 END AS st1 FROM s0a),
s1 AS (SELECT *, CASE WHEN span / (st1 / 5) <= {maxbins} THEN st1 / 5 ELSE st1 END AS st2 FROM s0b),
s2 AS (SELECT *, CASE WHEN span > 0 THEN (CASE WHEN span / (st2 / 2) <= {maxbins} THEN st2 / 2 ELSE st2 END)
                      ELSE 1.0 END AS step FROM s1),
p AS (SELECT *, floor(mn / step) * step AS start FROM s2),
q AS (SELECT *, greatest(1, ceil((mx - start) / step)) AS nb FROM p),
binned AS (SELECT CAST(least(floor((b.x - q.start) / q.step), q.nb - 1) AS BIGINT) AS bin{', b.' + by if by else ''},
                  q.start, q.step FROM b CROSS JOIN q)
SELECT bin{by_sel}, round(start + bin * step, 6) AS bin_start, round(start + (bin + 1) * step, 6) AS bin_end,
       count(*) AS count
FROM binned GROUP BY bin{by_sel}, start, step"""


@register("histogram_amount", _hist_sql(TXN_O_CTE, "txn_o", "transaction_amount", 50))
def q_histogram_amount(spark, sf):
    return finalize(agg.histogram(fx.transactions_orders(spark, sf), "transaction_amount", maxbins=50))


@register("histogram_amount_capped", _hist_sql(TXN_O_CTE, "txn_o WHERE transaction_amount <= 100000", "transaction_amount", 50))
def q_histogram_amount_capped(spark, sf):
    """The dashboard's amount histogram with its upper-amount filter."""
    return finalize(agg.histogram(fx.transactions_orders(spark, sf), "transaction_amount", maxbins=50, max_value=100000.0))


@register("histogram_log_amount", _hist_sql(TXN_O_CTE, "txn_o", "ln(1 + greatest(transaction_amount, 0))", 60))
def q_histogram_log_amount(spark, sf):
    return finalize(agg.histogram(fx.transactions_orders(spark, sf), agg.log1p_clipped("transaction_amount"),
                                  maxbins=60))


@register("histogram_by_label", _hist_sql(
    TXN_O_CTE + ",\nlab AS (SELECT *, CASE WHEN is_fraudulent = 1 THEN 'Fraud' WHEN is_fraudulent = 0 "
    "THEN 'Legit' ELSE CAST(is_fraudulent AS VARCHAR) END AS fraud_label FROM txn_o)",
    "lab", "transaction_amount", 50, by="fraud_label"))
def q_histogram_by_label(spark, sf):
    t = fx.transactions_orders(spark, sf).withColumn("fraud_label", agg.fraud_label_col("is_fraudulent"))
    return finalize(agg.histogram(t, "transaction_amount", maxbins=50, by="fraud_label"))


# ------------------------------------------------------------ 2.5 #60-#65 listing statistics

CMP_COLS = ["product_price", "discount_percentage", "seller_rating", "reviews_count", "seller_age_days"]


@register("class_comparison", f"""
WITH {LISTINGS_CTE}
SELECT is_fraud, {", ".join(f"round(avg({c}), 2) AS mean_{c}" for c in CMP_COLS)}
FROM listings GROUP BY is_fraud""")
def q_class_comparison(spark, sf):
    return finalize(agg.class_comparison(fx.listings(spark, sf), "is_fraud", CMP_COLS), digits=2)


@register("value_counts_desc", f"""
WITH {LISTINGS_CTE}
SELECT product_category, count(*) AS count FROM listings WHERE product_category IS NOT NULL
GROUP BY 1 ORDER BY count DESC, product_category""")
def q_value_counts_desc(spark, sf):
    return finalize(agg.value_counts(fx.listings(spark, sf), "product_category"))


@register("numeric_summary", f"""
WITH {LISTINGS_CTE}
SELECT round(avg(product_price), 4) AS mean, round(median(product_price), 4) AS median,
       round(min(product_price), 4) AS min, round(max(product_price), 4) AS max FROM listings""")
def q_numeric_summary(spark, sf):
    return finalize(agg.numeric_summary(fx.listings(spark, sf), "product_price"),
                    money=("mean", "median", "min", "max"))


FLAG_NAMES = ["high_discount_flag", "low_seller_rating_flag", "new_seller_flag", "low_reviews_flag",
              "risky_location_flag"]


@register("flag_counts", f"""
WITH {LISTINGS_CTE}
SELECT count(*) FILTER (WHERE discount_percentage > 70) AS n_high_discount_flag,
       count(*) FILTER (WHERE seller_rating < 4.0) AS n_low_seller_rating_flag,
       count(*) FILTER (WHERE seller_age_days < 90) AS n_new_seller_flag,
       count(*) FILTER (WHERE reviews_count < 10) AS n_low_reviews_flag,
       count(*) FILTER (WHERE item_location IN ('China', 'Hong Kong', 'Overseas')) AS n_risky_location_flag
FROM listings""")
def q_flag_counts(spark, sf):
    lst = fx.listings(spark, sf).withColumns(risk_flags())
    return finalize(agg.flag_counts(lst, FLAG_NAMES))


@register("global_quantile", f"""
WITH {TXN_O_CTE}
SELECT round(quantile_cont(transaction_amount, 0.95), 4) AS q95,
       round(quantile_cont(transaction_amount, 0.5), 4) AS q50 FROM txn_o""")
def q_global_quantile(spark, sf):
    t = fx.transactions_orders(spark, sf)
    return finalize(exact_quantiles(t, "transaction_amount", [0.95, 0.5], names=["q95", "q50"]),
                    money=("q95", "q50"))


@register("kept_quantile", f"""
WITH {TXN_O_CTE}
SELECT round(quantile_cont(transaction_amount, 0.95), 4) AS q95,
       round(quantile_cont(transaction_amount, 0.5), 4) AS q50 FROM txn_o""")
def q_kept_quantile(spark, sf):
    """The same values from the sketches and sorted files kept per year; the last year is added afterwards."""
    from ..operators import kept_quantiles as kq
    from ..sources import files
    t = fx.transactions_orders(spark, sf).select(F.year("transaction_date").alias("year"), "transaction_amount")
    folder = files.scratch_path(spark, "kept-quantiles")
    last = t.agg(F.max("year")).first()[0]
    kq.keep(t.where(F.col("year") < last), folder, "year", "transaction_amount")
    kq.keep(t.where(F.col("year") == last), folder, "year", "transaction_amount")
    row = {name: kq.quantile(spark, folder, q) for name, q in (("q95", 0.95), ("q50", 0.5))}
    return finalize(spark.createDataFrame([tuple(row.values())], "q95 double, q50 double"), money=("q95", "q50"))


@register("group_quantile_flags", f"""
WITH {LISTINGS_CTE},
q AS (SELECT product_category, quantile_cont(product_price, 0.15) AS lo, quantile_cont(product_price, 0.85) AS hi
      FROM listings GROUP BY 1)
SELECT l.transaction_id, l.product_category,
       coalesce(l.product_price < q.lo, false) AS is_too_cheap,
       coalesce(l.product_price > q.hi, false) AS is_too_expensive
FROM listings l LEFT JOIN q ON l.product_category = q.product_category""")
def q_group_quantile_flags(spark, sf):
    lst = fx.listings(spark, sf)
    out = agg.group_quantile_flags(lst, "product_category", "product_price")
    return out.select("transaction_id", "product_category", "is_too_cheap", "is_too_expensive")

"""Registered queries: joins, lookups and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features as ff
from ..functions.cleaning import normalize_key
from ..operators import joins as jn
from ..sources import fixtures as fx
from .common import CF_PROD_CTE, CF_TXN_CTE, RANGES_CTE, TXN_E_CTE, TXN_O_CTE, finalize, norm_sql, register
from .q_aggregates import _country_values_sql, category_rates, location_payment_rates, payment_rates

# ------------------------------------------------------------ identity join


@register("left_join_identity", """
SELECT d.doc_id AS TransactionID, d.n_chars AS TransactionAmt, d.lang AS ProductCD, d.source AS card_type,
       l.quality AS id_01, l.toxic AS id_02
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def q_left_join_identity(spark, sf):
    t, i = fx.identity_tables(spark, sf)
    return finalize(jn.left_join_identity(t, i, "TransactionID"))


@register("left_join_identity_colocated", """
SELECT d.doc_id AS TransactionID, d.n_chars AS TransactionAmt, d.lang AS ProductCD, d.source AS card_type,
       l.quality AS id_01, l.toxic AS id_02
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def q_left_join_identity_colocated(spark, sf):
    """Both sides stored in buckets of the id first; the join itself moves nothing."""
    from uuid import uuid4
    from ..sources import files
    t, i = fx.identity_tables(spark, sf)
    n, tag = int(spark.conf.get("spark.sql.shuffle.partitions")), uuid4().hex
    t, i = (jn.write_colocated(df, f"{name}_{tag}", "TransactionID", n, files.scratch_path(spark, name))
            for df, name in ((t, "transactions"), (i, "identity")))
    return finalize(jn.left_join_identity(t, i.hint("merge"), "TransactionID"))


@register("match_coverage_semi", """
SELECT count(*) AS n_rows, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels)) AS n_matched,
       round(100.0 * count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels)) / count(*), 6) AS pct_matched
FROM documents""")
def q_match_coverage_semi(spark, sf):
    t, i = fx.identity_tables(spark, sf)
    return finalize(jn.match_coverage(t, i, "TransactionID"))


# ------------------------------------------------------------ side-rate joins


def _txn_norm(spark, sf):
    t = fx.transactions_orders(spark, sf)
    return t.withColumns({c + "_norm": normalize_key(c)
                          for c in ("payment_method", "product_category", "customer_location")})


@register("join_rate_single_key", f"""
WITH {TXN_O_CTE}, {CF_TXN_CTE},
s AS (SELECT {norm_sql('payment_method')} AS k, avg(CAST(involves_counterfeit AS DOUBLE)) AS r,
             count(involves_counterfeit) AS n FROM cf_txn GROUP BY 1)
SELECT t.transaction_id, {norm_sql('t.payment_method')} AS payment_method_norm,
       round(coalesce(s.r, 0.0), 6) AS cnt_txn_counterfeit_rate_pm, coalesce(s.n, 0) AS cnt_txn_count_pm
FROM txn_o t LEFT JOIN s ON {norm_sql('t.payment_method')} = s.k""")
def q_join_rate_single_key(spark, sf):
    j = jn.enrich_left(_txn_norm(spark, sf), payment_rates(spark, sf), ["payment_method_norm"])
    j = j.fillna({"cnt_txn_counterfeit_rate_pm": 0.0, "cnt_txn_count_pm": 0})
    return finalize(j.select("transaction_id", "payment_method_norm", "cnt_txn_counterfeit_rate_pm",
                             "cnt_txn_count_pm"))


@register("join_rate_multi_key", f"""
WITH {TXN_O_CTE}, {CF_TXN_CTE},
s AS (SELECT {norm_sql('customer_location')} AS l, {norm_sql('payment_method')} AS p,
             avg(CAST(involves_counterfeit AS DOUBLE)) AS r, count(involves_counterfeit) AS n FROM cf_txn GROUP BY 1, 2)
SELECT t.transaction_id, round(coalesce(s.r, 0.0), 6) AS cnt_txn_counterfeit_rate_loc_pm,
       coalesce(s.n, 0) AS cnt_txn_count_loc_pm
FROM txn_o t LEFT JOIN s ON {norm_sql('t.customer_location')} = s.l AND {norm_sql('t.payment_method')} = s.p""")
def q_join_rate_multi_key(spark, sf):
    t = _txn_norm(spark, sf)
    j = jn.enrich_left(t, location_payment_rates(spark, sf), ["customer_location_norm", "payment_method_norm"])
    j = j.fillna({"cnt_txn_counterfeit_rate_loc_pm": 0.0, "cnt_txn_count_loc_pm": 0})
    return finalize(j.select("transaction_id", "cnt_txn_counterfeit_rate_loc_pm", "cnt_txn_count_loc_pm"))


@register("join_rate_diff_names", f"""
WITH {TXN_O_CTE}, {CF_PROD_CTE},
s AS (SELECT {norm_sql('category')} AS category_norm, avg(CAST(is_counterfeit AS DOUBLE)) AS r,
             count(is_counterfeit) AS n FROM cf_prod GROUP BY 1)
SELECT t.transaction_id, {norm_sql('t.product_category')} AS product_category_norm, s.category_norm,
       round(s.r, 6) AS cnt_prod_counterfeit_rate_cat, s.n AS cnt_prod_count_cat
FROM txn_o t LEFT JOIN s ON {norm_sql('t.product_category')} = s.category_norm""")
def q_join_rate_diff_names(spark, sf):
    t = _txn_norm(spark, sf)
    j = jn.enrich_left(t, category_rates(spark, sf), ["product_category_norm"], ["category_norm"],
                       keep_right_keys=True)
    return finalize(j.select("transaction_id", "product_category_norm", "category_norm",
                             "cnt_prod_counterfeit_rate_cat", "cnt_prod_count_cat"))


@register("map_lookup", f"""
WITH {TXN_O_CTE}, {CF_PROD_CTE},
m AS (SELECT category AS k, count(*) AS v FROM cf_prod WHERE NOT is_counterfeit GROUP BY 1)
SELECT t.transaction_id, t.product_category, coalesce(m.v, -1) AS category_size
FROM txn_o t LEFT JOIN m ON t.product_category = m.k""")
def q_map_lookup(spark, sf):
    t = fx.transactions_orders(spark, sf).select("transaction_id", "product_category")
    m = fx.counterfeit_products(spark, sf).where(~F.col("is_counterfeit")).groupBy(F.col("category").alias("k")).agg(
        F.count(F.lit(1)).alias("v"))
    return finalize(jn.map_lookup(t, "product_category", m, "k", "v", "category_size", default=-1))


# ------------------------------------------------------------ IP cache / range lookups


def ip_cache(spark, sf):
    """Previously resolved IPs: events of every third user; 'error' events
    cached with a null country (a failed lookup)."""
    e = fx.transactions_events(spark, sf)
    g = jn.ip_range_join(e.where(F.pmod("customer_id", F.lit(3)) == 0), "ip_number", fx.ip_ranges(spark, sf))
    return g.select(F.col("ip_address").alias("ip"),
                    F.when(F.col("product_category") != "error", F.col("country")).alias("country"))


CACHE_SQL = f"""
WITH {TXN_E_CTE}, {RANGES_CTE},
cache AS (SELECT t.ip_address AS ip, CASE WHEN t.product_category <> 'error' THEN r.country END AS country
          FROM txn_e t LEFT JOIN ip_ranges r ON t.ip_number BETWEEN r.ip_lo AND r.ip_hi
          WHERE t.customer_id % 3 = 0)"""


MISSING_SQL = """
SELECT ip_address, min(transaction_ts) AS first_seen FROM txn_e
WHERE ip_address IS NOT NULL AND trim(ip_address) <> '' AND ip_address NOT IN (SELECT ip FROM cache)
GROUP BY 1"""


@register("lookup_missing_keys", CACHE_SQL + MISSING_SQL)
def q_lookup_missing_keys(spark, sf):
    e = fx.transactions_events(spark, sf)
    return jn.lookup_missing_keys(e, "ip_address", "transaction_ts", ip_cache(spark, sf), "ip")


@register("lookup_missing_keys_limited", CACHE_SQL + MISSING_SQL + " ORDER BY first_seen, ip_address LIMIT 500")
def q_lookup_missing_keys_limited(spark, sf):
    """The same under a rate limit of 500 keys a run, here the feature."""
    e = fx.transactions_events(spark, sf)
    return jn.lookup_missing_keys(e, "ip_address", "transaction_ts", ip_cache(spark, sf), "ip", max_per_run=500)


@register("ip_range_join", f"""
WITH {TXN_E_CTE}, {RANGES_CTE}
SELECT t.transaction_id, t.ip_address, r.country, r.lat, r.lon
FROM txn_e t LEFT JOIN ip_ranges r ON t.ip_number BETWEEN r.ip_lo AND r.ip_hi""")
def q_ip_range_join(spark, sf):
    e = fx.transactions_events(spark, sf).select("transaction_id", "ip_address")
    e = e.withColumn("ip_number", jn.ipv4_to_long("ip_address"))
    g = jn.ip_range_join(e, "ip_number", fx.ip_ranges(spark, sf))
    return finalize(g.select("transaction_id", "ip_address", "country", "lat", "lon"))


NESTED_CTE = """
nested AS (
  SELECT ip_lo, ip_hi, country AS network FROM ip_ranges
  UNION ALL SELECT ip_lo + 3 * 16777216, ip_lo + 6 * 16777216 - 1, country || '/net' FROM ip_ranges
  UNION ALL SELECT ip_lo + 4 * 16777216, ip_lo + 4 * 16777216 + 1048575, country || '/net/sub' FROM ip_ranges
  UNION ALL SELECT ip_lo + 5 * 16777216, ip_lo + 8 * 16777216 - 1, country || '/over' FROM ip_ranges)"""


def nested_ranges(spark, sf):
    """Each country's range with a network in it, a smaller network in that, and one that overlaps the network's end."""
    r = fx.ip_ranges(spark, sf).select("ip_lo", "ip_hi", F.col("country").alias("network"))
    block = 16_777_216

    def part(begin, width, name):
        return r.select((F.col("ip_lo") + begin).alias("ip_lo"), (F.col("ip_lo") + begin + width - 1).alias("ip_hi"),
                        F.concat("network", F.lit(name)).alias("network"))
    return r.unionByName(part(3 * block, 3 * block, "/net")).unionByName(
        part(4 * block, 1 << 20, "/net/sub")).unionByName(part(5 * block, 3 * block, "/over"))


def _nested_join(spark, sf, strategy):
    e = fx.transactions_events(spark, sf).select("transaction_id", "ip_address")
    e = e.withColumn("ip_number", jn.ipv4_to_long("ip_address"))
    g = jn.ip_range_join(e, "ip_number", nested_ranges(spark, sf), strategy=strategy)
    return finalize(g.select("transaction_id", "ip_lo", "ip_hi", "network"))


NESTED_SQL = f"""
WITH {TXN_E_CTE}, {RANGES_CTE}, {NESTED_CTE}
SELECT t.transaction_id, r.ip_lo, r.ip_hi, r.network
FROM txn_e t LEFT JOIN nested r ON t.ip_number BETWEEN r.ip_lo AND r.ip_hi
QUALIFY row_number() OVER (PARTITION BY t.transaction_id ORDER BY r.ip_hi - r.ip_lo, r.ip_lo DESC) = 1"""


@register("ip_range_join_nested", NESTED_SQL)
def q_ip_range_join_nested(spark, sf):
    """Overlapping ranges: the most specific one, by blocks."""
    return _nested_join(spark, sf, "blocks")


@register("ip_range_join_merged", NESTED_SQL)
def q_ip_range_join_merged(spark, sf):
    """The same by the as-of merge, which tables of ranges beyond a broadcast take."""
    return _nested_join(spark, sf, "merge")


@register("country_to_iso3", f"""
WITH {TXN_E_CTE}, {RANGES_CTE}, {_country_values_sql()},
g AS (SELECT t.transaction_id, CASE WHEN t.transaction_id % 7 = 0 THEN 'Unknown'
                                    WHEN t.transaction_id % 11 = 0 THEN ' local network'
                                    WHEN t.transaction_id % 13 = 0 THEN 'U.S.'
                                    WHEN t.transaction_id % 17 = 0 THEN NULL ELSE r.country END AS country
      FROM txn_e t LEFT JOIN ip_ranges r ON t.ip_number BETWEEN r.ip_lo AND r.ip_hi),
k AS (SELECT *, lower(regexp_replace(country, '^\\s+|\\s+$', '', 'g')) AS nl FROM g)
SELECT k.transaction_id, k.country, c.iso3 FROM k LEFT JOIN countries c
  ON c.name_lower = CASE WHEN k.nl IN ('unknown', 'local network', 'nan', '') THEN NULL ELSE k.nl END""")
def q_country_to_iso3(spark, sf):
    e = fx.transactions_events(spark, sf)
    g = jn.ip_range_join(e, "ip_number", fx.ip_ranges(spark, sf))
    tid = F.col("transaction_id")
    variant = (F.when(F.pmod(tid, F.lit(7)) == 0, F.lit("Unknown"))
                .when(F.pmod(tid, F.lit(11)) == 0, F.lit(" local network"))
                .when(F.pmod(tid, F.lit(13)) == 0, F.lit("U.S."))
                .when(F.pmod(tid, F.lit(17)) == 0, F.lit(None).cast("string"))
                .otherwise(F.col("country")))
    g = g.select("transaction_id", variant.alias("country"))
    return finalize(jn.country_to_iso3(g, "country", "iso3"))


@register("cross_join_scalar", f"""
WITH {TXN_O_CTE}, m AS (SELECT avg(transaction_amount) AS mean_amount FROM txn_o)
SELECT transaction_id, round(transaction_amount / m.mean_amount, 6) AS amount_vs_mean FROM txn_o CROSS JOIN m""")
def q_cross_join_scalar(spark, sf):
    t = fx.transactions_orders(spark, sf)
    m = t.agg(F.avg("transaction_amount").alias("mean_amount"))
    j = jn.cross_join_scalar(t, m)
    return finalize(j.select("transaction_id", (F.col("transaction_amount") / F.col("mean_amount"))
                             .alias("amount_vs_mean")))


# ------------------------------------------------------------ 2.8 set operations


@register("distinct_values", f"""
WITH {TXN_E_CTE}
SELECT ip_address, min(transaction_id) AS first_seq FROM txn_e WHERE ip_address IS NOT NULL GROUP BY 1""")
def q_distinct_values(spark, sf):
    e = fx.transactions_events(spark, sf)
    return finalize(e.where(F.col("ip_address").isNotNull()).groupBy("ip_address")
                     .agg(F.min("transaction_id").alias("first_seq")))


@register("concat_columns", f"""
WITH {TXN_O_CTE}
SELECT transaction_id, isodow(transaction_date) - 1 AS tx_dayofweek, month(transaction_date) AS tx_month,
       CAST(least(greatest(transaction_hour, 0), 23) <= 6 OR least(greatest(transaction_hour, 0), 23) >= 22 AS INTEGER)
         AS is_night
FROM txn_o""")
def q_concat_columns(spark, sf):
    """Two feature frames put side by side by key join (never by position)."""
    t = fx.transactions_orders(spark, sf)
    dates = t.select("transaction_id", ff.weekday("transaction_date").alias("tx_dayofweek"),
                     F.month("transaction_date").alias("tx_month"))
    hours = t.select("transaction_id", ff.is_night("transaction_hour").alias("is_night"))
    return finalize(dates.join(hours, "transaction_id"))


@register("sink_json_lookup", CACHE_SQL + """,
missing AS (SELECT DISTINCT ip_address, ip_number FROM txn_e
            WHERE ip_address IS NOT NULL AND trim(ip_address) <> '' AND ip_address NOT IN (SELECT ip FROM cache)),
resolved AS (SELECT m.ip_address AS ip, r.country FROM missing m
             LEFT JOIN ip_ranges r ON m.ip_number BETWEEN r.ip_lo AND r.ip_hi)
SELECT ip, max(country) AS country FROM (
    SELECT ip, country FROM cache WHERE ip NOT IN (SELECT ip FROM resolved) UNION ALL SELECT ip, country FROM resolved)
GROUP BY ip""")
def q_sink_json_lookup(spark, sf):
    """One lookup-cache cycle: every distinct key missing from the cache is resolved once with the range join, merged
    into the cache, and the cache is persisted as JSON lines and read back."""
    from ..sources import files
    e = fx.transactions_events(spark, sf)
    cache = ip_cache(spark, sf)
    todo = jn.lookup_missing_keys(e, "ip_address", "transaction_ts", cache, "ip")
    todo = todo.select("ip_address", jn.ipv4_to_long("ip_address").alias("ip_number"))
    resolved = jn.ip_range_join(todo, "ip_number", fx.ip_ranges(spark, sf)).select(
        F.col("ip_address").alias("ip"), "country")
    path = files.scratch_path(spark, "ip-cache-json")
    files.sink_json(jn.merge_cache(cache, resolved, "ip"), path)
    return files.scan_json_lookup(spark, path, "ip string, country string")


@register("sink_versioned_lookup", CACHE_SQL + """
SELECT ip, max(country) AS country FROM cache GROUP BY ip""")
def q_sink_versioned_lookup(spark, sf):
    """The lookup cache in two versions: first without countries, then whole; readers see the last one published."""
    from ..sources import files, versions
    root = files.scratch_path(spark, "versions")
    cache = ip_cache(spark, sf).groupBy("ip").agg(F.max("country").alias("country"))
    versions.write_version(cache.withColumn("country", F.lit(None).cast("string")), root)
    versions.write_version(cache, root)
    return versions.read_version(spark, root, cache.schema)

"""Shared pieces of the query registry: the fixture views as SQL CTEs (for
the DuckDB oracle), registration, and result finalisation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ByteType, DecimalType, DoubleType, FloatType, IntegerType, LongType,
                               ShortType)

from ..sources.fixtures import NATION_NAMES

REGISTRY: dict[str, tuple[Callable, str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def finalize(df: DataFrame, digits: int = 6, money_digits: int = 4, money: tuple = (),
             exact: tuple = ()) -> DataFrame:
    """Stable output types: integral -> bigint, fractional -> double rounded
    (aggregates of doubles differ in the last bits between engines; ``money``
    columns use ``money_digits``).  ``exact`` columns are single IEEE
    operations on the inputs (e.g. one division), identical in every engine,
    and are not rounded: rounding could only split ties differently."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, (ByteType, ShortType, IntegerType, LongType)):
            cols.append(c.cast("bigint").alias(f.name))
        elif isinstance(t, (FloatType, DoubleType, DecimalType)):
            d = None if f.name in exact else (money_digits if f.name in money else digits)
            cols.append((F.round(c.cast("double"), d) if d is not None else c.cast("double")).alias(f.name))
        else:
            cols.append(c)
    return df.select(*cols)


# ---------------------------------------------------------------- SQL views
# Each mirrors a function of riskloom.sources.fixtures.

IP_SQL = "((({k})::HUGEINT * 2654435761) % 4294967296)::BIGINT"


def ip_text_sql(k: str) -> str:
    n = IP_SQL.format(k=k)
    return (f"concat_ws('.', (({n}) >> 24) & 255, (({n}) >> 16) & 255, "
            f"(({n}) >> 8) & 255, ({n}) & 255)")


LINES_CTE = """
lines AS (
  SELECT l_orderkey, sum(l_quantity) AS quantity,
         max(CASE WHEN l_returnflag = 'R' AND l_discount >= 0.09 THEN 1 ELSE 0 END) AS line_fraud,
         count(*) AS n_lines,
         sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS n_returned
  FROM lineitem GROUP BY l_orderkey)"""

TXN_O_CTE = LINES_CTE + """,
txn_o AS (
  SELECT o.o_orderkey AS transaction_id, o.o_custkey AS customer_id,
         o.o_totalprice AS transaction_amount, o.o_orderdate AS transaction_date,
         CAST(o.o_orderkey % 24 AS INTEGER) AS transaction_hour,
         o.o_orderpriority AS payment_method, c.c_mktsegment AS product_category,
         o.o_orderstatus AS device_used, n.n_name AS customer_location, l.quantity,
         CAST(18 + o.o_custkey % 70 AS INTEGER) AS customer_age,
         CAST(date_diff('day', CAST(o.o_orderdate AS DATE), DATE '2001-08-01') AS INTEGER) AS account_age_days,
         """ + ip_text_sql("o.o_custkey * 4 + o.o_orderkey % 4") + """ AS ip_address,
         'addr-' || CAST(o.o_custkey AS VARCHAR) AS shipping_address,
         'addr-' || CAST(CASE WHEN o.o_orderkey % 7 = 0 THEN o.o_orderkey ELSE o.o_custkey END AS VARCHAR)
           AS billing_address,
         CAST(coalesce(l.line_fraud, 0) AS INTEGER) AS is_fraudulent
  FROM orders o
  LEFT JOIN lines l ON o.o_orderkey = l.l_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey)"""

TXN_E_CTE = """
txn_e AS (
  SELECT event_id AS transaction_id, user_id AS customer_id, value AS transaction_amount,
         ts AS transaction_ts, CAST(hour(ts) AS INTEGER) AS transaction_hour,
         event_type AS product_category,
         """ + ip_text_sql("event_id") + """ AS ip_address,
         """ + IP_SQL.format(k="event_id") + """ AS ip_number,
         CAST(coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) >= 90, false) AS INTEGER)
           AS is_fraudulent
  FROM events)"""

CF_TXN_CTE = """
cf_txn AS (
  SELECT o.o_orderpriority AS payment_method, n.n_name AS customer_location,
         (l.l_returnflag = 'R') AS involves_counterfeit
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey)"""

CF_PROD_CTE = """
cf_prod AS (
  SELECT c.c_mktsegment AS category, n.n_name AS shipping_origin, (c.c_acctbal < 0) AS is_counterfeit
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey)"""

RANGES_CTE = """
ip_ranges AS (
  SELECT CAST(floor(n_nationkey * 4294967296 / 25) AS BIGINT) AS ip_lo,
         CAST(floor((n_nationkey + 1) * 4294967296 / 25) - 1 AS BIGINT) AS ip_hi,
         (""" + str(NATION_NAMES) + """)[CAST(n_nationkey % 25 AS INTEGER) + 1] AS country, CAST(-60.0 AS DOUBLE) + n_nationkey * CAST(5.0 AS DOUBLE) AS lat, CAST(-170.0 AS DOUBLE) + n_nationkey * CAST(14.0 AS DOUBLE) AS lon
  FROM nation)"""

LISTINGS_CTE = """
per_part AS (
  SELECT l_partkey, count(*) AS reviews_count, CAST(sum(l_quantity) AS INTEGER) AS sold_count,
         max(CASE WHEN l_returnflag = 'R' AND l_discount >= 0.09 THEN 1 ELSE 0 END) AS is_fraud
  FROM lineitem GROUP BY l_partkey),
listings AS (
  SELECT p.p_partkey AS transaction_id, p.p_partkey AS product_id, p.p_type AS product_category,
         p.p_name AS product_name, p.p_brand AS seller_name,
         p.p_retailprice * CAST(100 - (p.p_partkey * 7) % 90 AS DOUBLE) / 100.0 AS product_price,
         p.p_retailprice AS original_price,
         CAST((p.p_partkey * 7) % 90 AS INTEGER) AS discount_percentage,
         CAST(3.0 AS DOUBLE) + CAST(p.p_partkey % 21 AS DOUBLE) / 10.0 AS seller_rating,
         CAST(2.5 AS DOUBLE) + CAST(p.p_partkey % 26 AS DOUBLE) / 10.0 AS product_rating,
         CAST((p.p_partkey * 37) % 2000 AS INTEGER) AS seller_age_days,
         CAST(50 + p.p_partkey % 51 AS INTEGER) AS seller_response_rate,
         CAST(coalesce(pp.reviews_count, 0) AS INTEGER) AS reviews_count,
         CAST(coalesce(pp.sold_count, 0) AS INTEGER) AS sold_count,
         p.p_size AS watchers_count,
         (p.p_partkey % 10 = 0) AS is_official_store,
         (p.p_partkey % 4 = 0) AS is_top_rated_seller,
         (p.p_partkey % 3 <> 0) AS is_verified,
         (p.p_size % 2 = 0) AS has_return_policy,
         (['China', 'Hong Kong', 'Overseas', 'Singapore', 'Malaysia'])[CAST(p.p_partkey % 5 AS INTEGER) + 1]
           AS item_location,
         CAST(coalesce(pp.is_fraud, 0) AS INTEGER) AS is_fraud
  FROM part p LEFT JOIN per_part pp ON p.p_partkey = pp.l_partkey)"""


def norm_sql(c: str) -> str:
    """SQL twin of functions.cleaning.normalize_key."""
    return f"coalesce(lower(regexp_replace(CAST({c} AS VARCHAR), '^\\s+|\\s+$', '', 'g')), 'nan')"


def md5_unit_sql(k: str, salt: str = "") -> str:
    s = f"CAST({k} AS VARCHAR)" + (f" || '{salt}'" if salt else "")
    return f"(CAST(('0x' || substr(md5({s}), 1, 8)) AS BIGINT) / 4294967296.0)"


def md5_bucket_sql(k: str, n: int) -> str:
    return f"(CAST(('0x' || substr(md5(CAST({k} AS VARCHAR)), 1, 8)) AS BIGINT) % {n})"

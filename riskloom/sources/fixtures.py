"""Transaction-shaped views derived from the TPC-H-like test tables.

The reference works on e-commerce transaction CSVs; the repository's test
data is a star schema.  These functions derive the reference's schemas from
it with joins and aggregates only, so every query's work grows with the
tables.  Join order is chosen so that the big joins reuse partitioning:
lineitem is aggregated per order key first (map-side partial aggregation),
then joined to orders on that same key, and only then to customer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TWO_32 = 4294967296
# Knuth multiplicative hash used to spread ids over IPv4 space,
# and the discount at or above which a returned line marks its order as fraud.
IP_MULTIPLIER = 2654435761
FRAUD_DISCOUNT = 0.09
ACCOUNT_AGE_ANCHOR = "2001-08-01"
N_IP_SLICES = 25
# TPC-H specification nation names in nation-key order, used
# as the country of each IP slice (the test tables carry placeholder names).
NATION_NAMES = ["ALGERIA", "ARGENTINA", "BRAZIL", "CANADA", "EGYPT", "ETHIOPIA", "FRANCE", "GERMANY",
                "INDIA", "INDONESIA", "IRAN", "IRAQ", "JAPAN", "JORDAN", "KENYA", "MOROCCO",
                "MOZAMBIQUE", "PERU", "CHINA", "ROMANIA", "SAUDI ARABIA", "VIETNAM", "RUSSIA",
                "UNITED KINGDOM", "UNITED STATES"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ip_number(key: Column) -> Column:
    """(key * 2654435761) mod 2^32 without 64-bit overflow (decimal math)."""
    prod = key.cast("decimal(38,0)") * F.lit(IP_MULTIPLIER).cast("decimal(38,0)")
    return F.pmod(prod, F.lit(TWO_32).cast("decimal(38,0)")).cast("bigint")


def ip_to_text(n: Column) -> Column:
    parts = [F.shiftright(n, s).bitwiseAND(F.lit(255)) for s in (24, 16, 8, 0)]
    return F.concat_ws(".", *[p.cast("string") for p in parts])


def order_line_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order key: quantity, fraud flag, line and return counts."""
    li = table(spark, sf_dir, "lineitem")
    returned = F.col("l_returnflag") == "R"
    return li.groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("quantity"),
        F.max((returned & (F.col("l_discount") >= FRAUD_DISCOUNT)).cast("int")).alias("line_fraud"),
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(returned.cast("long")).alias("n_returned"),
    )


def transactions_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``txn_o``: one transaction per order, reference column names."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    lines = order_line_totals(spark, sf_dir).select("l_orderkey", "quantity", "line_fraud")
    j = (o.join(lines, o.o_orderkey == lines.l_orderkey, "left")
          .join(c, o.o_custkey == c.c_custkey)
          .join(n, F.col("c_nationkey") == F.col("n_nationkey")))
    return j.select(
        F.col("o_orderkey").alias("transaction_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_totalprice").alias("transaction_amount"),
        F.col("o_orderdate").alias("transaction_date"),
        F.pmod(F.col("o_orderkey"), F.lit(24)).cast("int").alias("transaction_hour"),
        F.col("o_orderpriority").alias("payment_method"),
        F.col("c_mktsegment").alias("product_category"),
        F.col("o_orderstatus").alias("device_used"),
        F.col("n_name").alias("customer_location"),
        F.col("quantity"),
        (F.lit(18) + F.pmod(F.col("o_custkey"), F.lit(70))).cast("int").alias("customer_age"),
        F.datediff(F.lit(ACCOUNT_AGE_ANCHOR).cast("date"), F.col("o_orderdate").cast("date"))
         .alias("account_age_days"),
        ip_to_text(ip_number(F.col("o_custkey") * 4 + F.pmod(F.col("o_orderkey"), F.lit(4)))).alias("ip_address"),
        F.concat(F.lit("addr-"), F.col("o_custkey").cast("string")).alias("shipping_address"),
        F.concat(F.lit("addr-"), F.when(F.pmod(F.col("o_orderkey"), F.lit(7)) == 0, F.col("o_orderkey"))
                 .otherwise(F.col("o_custkey")).cast("string")).alias("billing_address"),
        F.coalesce(F.col("line_fraud"), F.lit(0)).cast("int").alias("is_fraudulent"),
    )


def events_k(c: Column) -> Column:
    return F.get_json_object(c, "$.k").try_cast("int")


def transactions_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``txn_e``: one transaction per event with true event times."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("transaction_id"),
        F.col("user_id").alias("customer_id"),
        F.col("value").alias("transaction_amount"),
        F.col("ts").alias("transaction_ts"),
        F.hour("ts").alias("transaction_hour"),
        F.col("event_type").alias("product_category"),
        ip_to_text(ip_number(F.col("event_id"))).alias("ip_address"),
        ip_number(F.col("event_id")).alias("ip_number"),
        F.coalesce((events_k(F.col("props")) >= 90).cast("int"), F.lit(0)).alias("is_fraudulent"),
    )


def counterfeit_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row-level counterfeit-transaction side table (one row per line)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = (li.join(o, li.l_orderkey == o.o_orderkey)
           .join(c, F.col("o_custkey") == F.col("c_custkey"))
           .join(n, F.col("c_nationkey") == F.col("n_nationkey")))
    return j.select(
        F.col("o_orderpriority").alias("payment_method"),
        F.col("n_name").alias("customer_location"),
        (F.col("l_returnflag") == "R").alias("involves_counterfeit"),
    )


def counterfeit_transaction_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same side table pre-aggregated to (payment, location, n, n_flagged).

    Identical rates to the row-level table, but lineitem is collapsed per
    order before the orders join and per (customer, payment) before the
    customer join, so neither big join carries line-level rows.
    """
    lines = order_line_totals(spark, sf_dir).select("l_orderkey", "n_lines", "n_returned")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    per_cust = (o.join(lines, o.o_orderkey == lines.l_orderkey)
                 .groupBy("o_custkey", "o_orderpriority")
                 .agg(F.sum("n_lines").alias("n"), F.sum("n_returned").alias("n_flagged")))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = (per_cust.join(c, per_cust.o_custkey == c.c_custkey)
                 .join(n, F.col("c_nationkey") == F.col("n_nationkey")))
    return (j.groupBy(F.col("o_orderpriority").alias("payment_method"),
                      F.col("n_name").alias("customer_location"))
             .agg(F.sum("n").alias("n"), F.sum("n_flagged").alias("n_flagged")))


def counterfeit_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", "c_acctbal")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = c.join(n, c.c_nationkey == n.n_nationkey)
    return j.select(
        F.col("c_mktsegment").alias("category"),
        F.col("n_name").alias("shipping_origin"),
        (F.col("c_acctbal") < 0).alias("is_counterfeit"),
    )


def ip_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IPv4 range dimension: nation k owns slice k of 25 equal slices."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey").cast("bigint")
    return n.select(
        F.floor(k * F.lit(TWO_32) / F.lit(N_IP_SLICES)).cast("bigint").alias("ip_lo"),
        (F.floor((k + 1) * F.lit(TWO_32) / F.lit(N_IP_SLICES)) - 1).cast("bigint").alias("ip_hi"),
        F.element_at(F.array(*[F.lit(x) for x in NATION_NAMES]),
                     (F.pmod(k, F.lit(N_IP_SLICES)) + 1).cast("int")).alias("country"),
        (F.lit(-60.0) + k * F.lit(5.0)).alias("lat"),
        (F.lit(-170.0) + k * F.lit(14.0)).alias("lon"),
    )


# Item locations cycled over parts for the listing fixture.
LISTING_LOCATIONS = ["China", "Hong Kong", "Overseas", "Singapore", "Malaysia"]


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marketplace listings: one per part, counts aggregated from lineitem."""
    li = table(spark, sf_dir, "lineitem")
    per_part = li.groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("reviews_count"),
        F.sum("l_quantity").cast("int").alias("sold_count"),
        F.max(((F.col("l_returnflag") == "R") & (F.col("l_discount") >= FRAUD_DISCOUNT)).cast("int"))
         .alias("is_fraud"),
    )
    p = table(spark, sf_dir, "part")
    j = p.join(per_part, p.p_partkey == per_part.l_partkey, "left")
    key = F.col("p_partkey")
    disc = F.pmod(key * 7, F.lit(90)).cast("int")
    loc = F.element_at(F.array(*[F.lit(x) for x in LISTING_LOCATIONS]),
                       (F.pmod(key, F.lit(len(LISTING_LOCATIONS))) + 1).cast("int"))
    return j.select(
        key.alias("transaction_id"),
        key.alias("product_id"),
        F.col("p_type").alias("product_category"),
        F.col("p_name").alias("product_name"),
        F.col("p_brand").alias("seller_name"),
        (F.col("p_retailprice") * (F.lit(100) - disc).cast("double") / 100.0).alias("product_price"),
        F.col("p_retailprice").alias("original_price"),
        disc.alias("discount_percentage"),
        (F.lit(3.0) + F.pmod(key, F.lit(21)) / 10.0).alias("seller_rating"),
        (F.lit(2.5) + F.pmod(key, F.lit(26)) / 10.0).alias("product_rating"),
        F.pmod(key * 37, F.lit(2000)).cast("int").alias("seller_age_days"),
        (F.lit(50) + F.pmod(key, F.lit(51))).cast("int").alias("seller_response_rate"),
        F.coalesce(F.col("reviews_count"), F.lit(0)).cast("int").alias("reviews_count"),
        F.coalesce(F.col("sold_count"), F.lit(0)).cast("int").alias("sold_count"),
        F.col("p_size").alias("watchers_count"),
        (F.pmod(key, F.lit(10)) == 0).alias("is_official_store"),
        (F.pmod(key, F.lit(4)) == 0).alias("is_top_rated_seller"),
        (F.pmod(key, F.lit(3)) != 0).alias("is_verified"),
        (F.pmod(F.col("p_size"), F.lit(2)) == 0).alias("has_return_policy"),
        loc.alias("item_location"),
        F.coalesce(F.col("is_fraud"), F.lit(0)).cast("int").alias("is_fraud"),
    )


def identity_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(transactions, identity) pair keyed by TransactionID."""
    d = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("TransactionID"), F.col("n_chars").alias("TransactionAmt"),
        F.col("lang").alias("ProductCD"), F.col("source").alias("card_type"))
    lab = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("TransactionID"), F.col("quality").alias("id_01"),
        F.col("toxic").alias("id_02"))
    return d, lab

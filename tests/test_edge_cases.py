"""Hand-made edge cases (FIXTURES.md section 3)."""

import datetime as dt

from pyspark.sql import functions as F

from riskloom.functions import cleaning as fc
from riskloom.functions import features as ff
from riskloom.operators import aggregates as agg
from riskloom.operators import clean, encoders, joins, metrics, schema, windows


def col(df, name):
    if isinstance(name, int):
        name = df.columns[name]
    return [r[0] for r in df.select(F.col(f"`{name}`")).collect()]


def test_account_age_bins(spark):
    df = spark.createDataFrame([(float(x),) for x in [-1, 0, 30, 30.5, 90, 20000, 20001]] + [(None,)], "d double")
    assert col(df.select(ff.account_age_bucket("d")), 0) == [-1, 0, 0, 1, 1, 5, -1, -1]


def test_customer_age_bins(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 20, 21, 120, 121]], "a double")
    assert col(df.select(ff.customer_age_bucket("a")), 0) == [0, 0, 1, 5, -1]


def test_null_key_joins_as_nan(spark):
    left = spark.createDataFrame([(1, None), (2, " Card\t")], "id int, pm string")
    side = spark.createDataFrame([(None, 0.5), ("card", 0.2)], "pm string, r double")
    l2 = left.withColumn("k", fc.normalize_key("pm"))
    s2 = side.select(fc.normalize_key("pm").alias("k"), "r")
    out = {r.id: r.r for r in joins.enrich_left(l2, s2, ["k"]).collect()}
    assert out == {1: 0.5, 2: 0.2}


def test_null_entity_gets_zero_not_shared_group(spark):
    df = spark.createDataFrame([(1, None, 10.0), (2, None, 20.0), (3, 7, 5.0)],
                               "transaction_id int, customer_id int, transaction_amount double")
    out = {r.transaction_id: (r.cust_txn_count, r.cust_txn_sum, r.cust_txn_mean)
           for r in windows.customer_totals(df).collect()}
    assert out[1] == (0, 0.0, 0.0) and out[2] == (0, 0.0, 0.0) and out[3] == (1, 5.0, 5.0)


def test_hours_is_night(spark):
    df = spark.createDataFrame([(None,), (0,), (6,), (7,), (21,), (22,), (23,), (30,)], "h int")
    assert col(df.select(ff.is_night("h")), 0) == [1, 1, 1, 0, 0, 1, 1, 1]


def test_velocity_edges(spark):
    t0 = dt.datetime(2024, 1, 1, 0, 0, 0)
    rows = [
        (1, 1, t0, 10.0),
        (2, 1, t0, 20.0),                                   # same time: no self / peer leak
        (3, 1, t0 + dt.timedelta(days=7), 5.0),             # exactly 7 days later: t0 rows excluded
        (4, 1, t0 + dt.timedelta(days=7, seconds=1), 1.0),
        (5, 2, t0 + dt.timedelta(hours=1), 3.0),            # second customer's first row
        (6, None, t0, 4.0),
    ]
    df = spark.createDataFrame(rows, "transaction_id int, customer_id int, transaction_ts timestamp_ntz, "
                                     "transaction_amount double")
    out = {r.transaction_id: (r.tx_count_7d, r.amount_sum_7d) for r in windows.velocity(
        df, window_us=7 * windows.DAY_US, suffix="7d").collect()}
    assert out[1] == (0, 0.0) and out[2] == (0, 0.0)
    # previous time of row 3 is t0: window (t0-7d, t0] holds rows 1, 2
    assert out[3] == (2, 30.0)
    # previous time of row 4 is t0+7d: window (t0, t0+7d] holds row 3 only
    assert out[4] == (1, 5.0)
    assert out[5] == (0, 0.0) and out[6] == (0, 0.0)


def test_velocity_long_gap_uses_previous_bucket(spark):
    t0 = dt.datetime(2024, 1, 1, 12)
    rows = [(1, 1, t0, 1.0), (2, 1, t0 + dt.timedelta(hours=1), 2.0), (3, 1, t0 + dt.timedelta(days=30), 4.0)]
    df = spark.createDataFrame(rows, "transaction_id int, customer_id int, transaction_ts timestamp_ntz, "
                                     "transaction_amount double")
    out = {r.transaction_id: (r.tx_count_1d, r.amount_sum_1d) for r in windows.velocity(df).collect()}
    assert out == {1: (0, 0.0), 2: (1, 1.0), 3: (2, 3.0)}


def test_calendar_gap_and_ma7(spark):
    rows = [(1, dt.datetime(2024, 1, 1, 5), 1), (2, dt.datetime(2024, 1, 8, 5), 0)]
    df = spark.createDataFrame(rows, "transaction_id int, ts timestamp_ntz, is_fraudulent int")
    d = agg.daily_ma7(agg.daily_series(df, "ts")).orderBy("day").collect()
    assert len(d) == 8
    assert [r.transactions for r in d] == [1, 0, 0, 0, 0, 0, 0, 1]
    assert all(r.transactions_ma7 is None for r in d[:6]) and d[6].transactions_ma7 is not None
    assert d[1].fraud_rate == 0.0 and d[0].fraud_rate == 100.0


def test_zero_quantity(spark):
    df = spark.createDataFrame([(10.0, 0.0), (10.0, None), (10.0, 4.0)], "a double, q double")
    assert col(df.select(ff.amount_per_unit("a", "q")), 0) == [10.0, 10.0, 2.5]


def test_unseen_category(spark):
    train = spark.createDataFrame([(i, "a" if i % 2 else "b", i % 2) for i in range(20)],
                                  "transaction_id int, cat string, y int")
    test = spark.createDataFrame([(100, "zzz", 0), (101, None, 1)], "transaction_id int, cat string, y int")
    _, [f] = encoders.frequency_encode(train, [test], "cat")
    assert col(f.orderBy("transaction_id"), "cat_freq") == [0.0, 0.0]
    _, [t] = encoders.target_encode_kfold(train, [test], "cat", "y", "transaction_id")
    g = 10 / 20
    assert col(t.orderBy("transaction_id"), "cat_te") == [g, g]


def test_score_ties_auc_half(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "y int, p double")
    # pairs: (0.5 vs 0.5) 1/2, (0.5 vs 0.1) 1, (0.9 vs 0.5) 1, (0.9 vs 0.1) 1 -> 3.5 / 4
    assert metrics.roc_auc(df, "y", "p").first().auc == 0.875


def test_no_positive_predictions(spark):
    df = spark.createDataFrame([(1, 0.05), (0, 0.01), (1, 0.09)], "y int, p double")
    best = metrics.best_f1_threshold(df, "y", "p").first()
    assert best.best_f1 == 0.0 and abs(best.best_threshold - 0.1) < 1e-12
    m = metrics.confusion_metrics(df, "y", "p", 0.1).first()
    assert (m.precision, m.recall, m.f1) == (0.0, 0.0, 0.0)


def test_duplicate_ids_keep_earliest(spark):
    df = spark.createDataFrame([(1, 2, "late"), (1, 1, "early"), (2, 5, "only")], "id int, ts int, v string")
    out = {r.id: r.v for r in clean.dedup_keep_first(df, "id", ["ts"]).collect()}
    assert out == {1: "early", 2: "only"}


def test_label_coercion(spark):
    df = spark.createDataFrame([("Yes",), (" TRUE ",), ("0",), ("x",), (None,), ("2",)], "s string")
    assert col(df.select(fc.coerce_binary_target("s")), 0) == [1, 1, 0, 0, 0, 2]


def test_risk_score_floor(spark):
    df = spark.createDataFrame([(False, False, False, False, False, False, True, True, True)],
                               "a boolean, b boolean, c boolean, d boolean, e boolean, f boolean, "
                               "ret boolean, ver boolean, off boolean")
    s = df.select(ff.fraud_risk_score("a", "b", "c", "d", "e", "f", "ret", "ver", "off")).first()[0]
    assert s == 0


def test_header_names(spark):
    df = spark.createDataFrame([(1.0,)], "`x` double").withColumnRenamed("x", " Transaction  Amount-($) ")
    assert fc.normalize_name(" Transaction  Amount-($) ") == "transaction_amount"
    assert schema.normalize_columns(df).columns == ["transaction_amount"]
    raw = spark.createDataFrame([(1.0, 2)], "`Transaction Amount` double, `Quantity` int")
    assert schema.rename_clean_headers(raw).columns == ["transaction_amount", "Quantity"]


def test_rule_points_and_levels(spark):
    df = spark.createDataFrame([(2500.0, "PayPal", "b", "s", "Mobile", 20.0), (100.0, "Cash", None, "s", "Desktop", 1.0),
                                (600.0, "Credit Card", "", "s", "Tablet", 80.0)],
                               "amount double, pay string, bill string, ship string, dev string, base double")
    pts = col(df.select(ff.rule_points("amount", "pay", "bill", "ship", "dev")), 0)
    assert pts == [90, 0, 40]
    fin = df.select(ff.tx_final_probability("base", ff.rule_points("amount", "pay", "bill", "ship", "dev")).alias("p"))
    lv = col(fin.select(ff.risk_level("p", 75, 40)), 0)
    assert lv == ["High", "Low", "High"]


def test_country_iso3_rules(spark):
    df = spark.createDataFrame([("United States",), ("  uk ",), ("Unknown",), ("local network",), ("",), (None,),
                                ("FRANCE",), ("Atlantis",), ("DEU",)], "c string")
    assert col(joins.country_to_iso3(df, "c"), "iso3") == ["USA", "GBR", None, None, None, None, "FRA", None, "DEU"]


def test_country_iso3_over_the_world(spark):
    """Expected codes written down independently of the locale data."""
    world = {"Australia": "AUS", "Nigeria": "NGA", "Netherlands": "NLD", "Spain": "ESP", "Italy": "ITA", "Poland": "POL",
             "Sweden": "SWE", "Norway": "NOR", "Denmark": "DNK", "Finland": "FIN", "Iceland": "ISL", "Ireland": "IRL",
             "Portugal": "PRT", "Greece": "GRC", "Austria": "AUT", "Switzerland": "CHE", "Belgium": "BEL", "Ukraine": "UKR",
             "Turkey": "TUR", "Israel": "ISR", "Pakistan": "PAK", "Bangladesh": "BGD", "Sri Lanka": "LKA", "Nepal": "NPL",
             "Thailand": "THA", "Philippines": "PHL", "Malaysia": "MYS", "Singapore": "SGP", "Taiwan": "TWN",
             "South Korea": "KOR", "North Korea": "PRK", "Republic of Korea": "KOR", "Viet Nam": "VNM", "Vietnam": "VNM",
             "Russian Federation": "RUS", "Russia": "RUS", "Czechia": "CZE", "Czech Republic": "CZE", "Hong Kong": "HKG",
             "Mexico": "MEX", "Chile": "CHL", "Colombia": "COL", "Cuba": "CUB", "Ghana": "GHA", "Senegal": "SEN",
             "South Africa": "ZAF", "Zimbabwe": "ZWE", "Tanzania": "TZA", "Uganda": "UGA", "Sudan": "SDN", "New Zealand": "NZL",
             "Fiji": "FJI", "Papua New Guinea": "PNG", "Cambodia": "KHM", "Mongolia": "MNG", "Kazakhstan": "KAZ",
             "Bosnia and Herzegovina": "BIH", "Saint Lucia": "LCA", "Trinidad and Tobago": "TTO", "au": "AUS", "nga": "NGA"}
    df = spark.createDataFrame(list(world.items()), "c string, expected string")
    bad = joins.country_to_iso3(df, "c").where("iso3 is null or iso3 <> expected").collect()
    assert bad == []
    assert len(set(joins.country_names(spark).values())) >= 245


def test_hour_dow_matrix_missing_cells(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 3), 1), (dt.datetime(2024, 1, 1, 3), 0)],
                               "ts timestamp_ntz, is_fraudulent int")
    m = agg.hour_dow_matrix(df, "ts").orderBy("dow_idx").collect()
    assert [r.dow for r in m] == agg.DAY_NAMES
    assert m[0].h03 == 1 and sum(r.h03 for r in m) == 1 and m[1].h00 == 0


def test_lookup_missing_keys_cap_and_null_cache(spark):
    keys = spark.createDataFrame([(f"10.0.0.{i}", i) for i in range(10)] + [("", 99), (None, 100)], "ip string, seq int")
    cache = spark.createDataFrame([("10.0.0.1", None), ("10.0.0.2", "X")], "ip string, country string")
    out = col(joins.lookup_missing_keys(keys, "ip", "seq", cache, "ip", max_per_run=3), "ip")
    assert out == ["10.0.0.0", "10.0.0.3", "10.0.0.4"]
    every = joins.lookup_missing_keys(keys.unionByName(keys), "ip", "seq", cache, "ip")
    assert sorted(col(every, "ip")) == sorted(f"10.0.0.{i}" for i in range(10) if i not in (1, 2))


def test_merge_cache_has_one_row_per_key(spark):
    schema = "ip string, country string"
    cache = spark.createDataFrame([("a", None), ("a", "X"), ("b", "Y"), ("c", None)], schema)
    new = spark.createDataFrame([("b", "Z"), ("d", "W"), ("d", "W")], schema)
    got = sorted((r.ip, r.country) for r in joins.merge_cache(cache, new).collect())
    assert got == [("a", "X"), ("b", "Z"), ("c", None), ("d", "W")]


def test_ipv4_parse(spark):
    df = spark.createDataFrame([("1.2.3.4",), ("255.255.255.255",), ("1.2.3",), ("1.2.3.256",), ("a.b.c.d",)], "ip string")
    assert col(df.select(joins.ipv4_to_long("ip")), 0) == [16909060, 4294967295, None, None, None]


def test_velocity_independent_of_session_time_zone(spark):
    # rows straddle the US spring-forward change; results must not move
    t0 = dt.datetime(2024, 3, 9, 12, 0, 0)
    rows = [(i, 1, t0 + dt.timedelta(hours=5 * i), float(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "transaction_id int, customer_id int, transaction_ts timestamp_ntz, "
                                     "transaction_amount double")
    def run():
        return sorted(tuple(r) for r in windows.velocity(df).select(
            "transaction_id", "tx_count_1d", "amount_sum_1d").collect())
    utc = run()
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        ny = run()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert utc == ny

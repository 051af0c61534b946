import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskloom.operators import windows
from riskloom.plans import feature_job

DAY = dt.datetime(2024, 3, 1, 12)
ROWS = [(i, None if i % 7 == 0 else i % 5, None if i % 11 == 0 else float(i), None if i % 13 == 0 else DAY + dt.timedelta(
    days=i % 3), str(i % 24), None if i % 17 == 0 else f"10.0.0.{i % 4}", "m" if i % 2 else None, i % 90, i % 60, 1 + i % 3,
    "addr") for i in range(60)]
ROWS += ROWS[:9]  # repeated rows
SCHEMA = ("transaction_id long, customer_id long, transaction_amount double, transaction_date timestamp_ntz, "
          "transaction_hour string, ip_address string, device_used string, account_age_days int, customer_age int, "
          "quantity int, shipping_address string")


@pytest.fixture
def no_broadcast(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {n: spark.conf.get(n, None) for n in names}
    for n in names:
        spark.conf.set(n, "-1")
    yield
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def test_wide_rows_are_shuffled_once_for_customers_and_addresses(spark, no_broadcast):
    t = feature_job.engineer(spark.createDataFrame(ROWS, SCHEMA))
    physical = t._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    blocks = [b for b in physical.split("\n\n") if "Exchange\n" in b.split("Input")[0] + "\n" and "hashpartitioning" in b]
    wide = [b for b in blocks if "shipping_address" in b and "device_used#" not in b.split("Arguments")[1]]
    assert len(wide) == 1 and feature_job.ROW in wide[0]


def test_entity_features_equal_counts_by_hand(spark):
    got = feature_job.engineer(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert len(got) == len(ROWS)

    def count(match):
        return float(sum(r[2] is not None for r in ROWS if match(r)) + sum(r[2] is None for r in ROWS if match(r)))

    for r in got:
        own = next(x for x in ROWS if x[0] == r.transaction_id)
        same = count(lambda x: x[1] == own[1]) if own[1] is not None else 0.0
        day = own[3] and own[3].date()
        assert r.cust_total_txn == same
        assert r.cust_txn_per_day == (count(lambda x: x[1] == own[1] and x[3] and x[3].date() == day)
                                      if own[1] is not None and day else 0.0)
        assert r.ip_txn_count == (count(lambda x: x[5] == own[5]) if own[5] else 0.0)
    assert feature_job.ROW not in got[0].asDict()


def test_row_numbers_give_the_same_counts(spark):
    base = spark.createDataFrame(ROWS, SCHEMA).withColumn("n", F.monotonically_increasing_id()).localCheckpoint()
    for keys in (["customer_id"], ["customer_id", "device_used"], ["ip_address"]):
        plain = windows.entity_count(base, keys, "c").select("n", "c", "c_log").collect()
        by_row = windows.entity_count(base, keys, "c", stats_from=base, row_id="n").select("n", "c", "c_log").collect()
        assert sorted(plain) == sorted(by_row)

"""Sources and sinks: schemas, malformed input, missing paths."""

import pytest

from riskloom.sources import files


def test_scan_csv_malformed_becomes_null(spark):
    path = files.scratch_path(spark, "t-csv")
    raw = spark.createDataFrame([("1", "2.5"), ("2", "oops"), ("x", "3")], "a string, b string")
    raw.write.option("header", True).csv(path)
    df = files.scan_csv(spark, path, "a int, b double")
    rows = sorted(df.collect(), key=lambda r: (r.a is None, r.a or 0))
    assert [(r.a, r.b) for r in rows] == [(1, 2.5), (2, None), (None, 3.0)]


def test_scan_first_existing(spark):
    good = files.scratch_path(spark, "t-first")
    spark.range(3).write.parquet(good)
    assert files.scan_first_existing(spark, [good + "-missing", good]).count() == 3
    with pytest.raises(FileNotFoundError):
        files.scan_first_existing(spark, [good + "-a", good + "-b"])


def test_scan_json_lookup_missing_and_malformed(spark):
    base = files.scratch_path(spark, "t-json")
    assert files.scan_json_lookup(spark, base + "-absent", "ip string, country string").count() == 0
    spark.sparkContext.parallelize(['{"ip": "1.1.1.1", "country": "X"}', 'not json', '{"ip": "2.2.2.2", "country": null}'],
                                   1).saveAsTextFile(base)
    got = sorted((r.ip, r.country) for r in files.scan_json_lookup(spark, base, "ip string, country string").collect())
    assert got == [("1.1.1.1", "X"), ("2.2.2.2", None)]


def test_sink_json_roundtrip(spark):
    path = files.scratch_path(spark, "t-sink")
    df = spark.createDataFrame([("a", 1), ("b", None)], "k string, v long")
    files.sink_json(df, path)
    assert sorted(spark.read.schema("k string, v long").json(path).collect()) == sorted(df.collect())

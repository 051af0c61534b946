"""Versioned stores, co-located tables, the kept daily series and the tile pyramid."""

import os
from datetime import datetime

import pytest

from riskloom.operators import aggregates as agg
from riskloom.operators import joins as jn
from riskloom.sources import versions
from riskloom.streaming import daily


def test_versions_are_seen_whole(spark, tmp_path):
    root = str(tmp_path / "store")
    read = lambda: sorted(r.x for r in versions.read_version(spark, root, "x long").collect())
    assert read() == [] and versions.current_version(spark, root) is None and versions.prune(spark, root) == []
    first = versions.write_version(spark.range(3).toDF("x"), root)
    assert read() == [0, 1, 2]
    # a writer that dies after its data and before the swap changes nothing
    lost = versions.begin_version(spark, root)
    spark.range(9).toDF("x").write.parquet(f"{root}/{lost}/data")
    assert read() == [0, 1, 2] and versions.current_version(spark, root) == first
    held = versions.read_version(spark, root, "x long")
    second = versions.write_version(spark.range(5).toDF("x"), root)
    assert read() == [0, 1, 2, 3, 4] and second > lost > first
    assert held.count() == 3  # a reader of the old version goes on
    third = versions.write_version(spark.range(1).toDF("x"), root)
    assert versions.prune(spark, root, keep=2) == [first, lost]
    assert read() == [0] and versions.read_version(spark, root, "x long", version=second).count() == 5
    assert sorted(n for n in os.listdir(root) if n.startswith("v-")) == [second, third]


def test_a_failing_write_leaves_the_current_version(spark, tmp_path):
    root = str(tmp_path / "store")
    versions.write_version(spark.range(2).toDF("x"), root)
    bad = spark.range(4).selectExpr("CASE WHEN id = 3 THEN raise_error('stop') ELSE id END AS x").selectExpr(
        "CAST(x AS BIGINT) AS x")
    with pytest.raises(Exception, match="stop"):
        versions.write_version(bad, root)
    assert versions.read_version(spark, root, "x long").count() == 2


def test_colocated_join_moves_nothing(spark, tmp_path):
    a = spark.range(500).selectExpr("id AS k", "id * 2 AS a")
    b = spark.range(0, 500, 3).selectExpr("id AS k", "id * 5 AS b")
    x = jn.write_colocated(a, "colocated_a", "k", 4, str(tmp_path / "a"))
    y = jn.write_colocated(b, "colocated_b", "k", 4, str(tmp_path / "b"))
    joined = jn.left_join_identity(x, y.hint("merge"), "k")
    rows = {r.k: (r.a, r.b) for r in joined.collect()}
    assert rows == {k: (2 * k, 5 * k if k % 3 == 0 else None) for k in range(500)}
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    for name in ("colocated_a", "colocated_b"):
        spark.sql(f"DROP TABLE {name}")


DDL = "transaction_id long, transaction_ts timestamp_ntz, is_fraudulent int"


def test_daily_series_is_kept_up_to_date(spark, tmp_path):
    src, folder, checkpoint = (str(tmp_path / n) for n in ("src", "deltas", "checkpoint"))
    day = lambda d, h=5: datetime(2024, 3, d, h)
    sets = [[(1, day(1), 0), (2, day(1), 1), (3, day(2), 0), (9, None, 1)], [(4, day(6), 1), (5, day(6), None)],
            [(6, day(1), 1), (7, day(2), 0), (8, day(5, 1), 0)]]
    schema = spark.createDataFrame([], DDL).schema
    for i, rows in enumerate(sets):
        spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(src)
        daily.start_daily(spark, src, schema, folder, checkpoint).awaitTermination()
        known = spark.createDataFrame([r for s in sets[:i + 1] for r in s if r[1]], DDL)
        want = agg.daily_series(known.fillna(0, ["is_fraudulent"]), "transaction_ts")
        assert sorted(map(tuple, daily.daily_series(spark, folder).collect())) == sorted(map(tuple, want.collect()))
    assert sorted((r.batch, r.day.day, r.late) for r in daily.late_rows(spark, folder).collect()) == [(2, 1, 1), (2, 2, 1)]
    assert daily.deltas(spark, folder).select("batch").distinct().count() == 3


def test_tiles(spark):
    df = spark.createDataFrame([(0.0, 0.0), (10.0, 20.0), (-10.0, 20.0), (10.0, -20.0), (90.0, 179.9), (-90.0, 180.0),
                                (None, 1.0)], "lat double, lon double")
    rows = agg.geo_heat_pyramid(df, zoom=6).collect()
    by_zoom = {}
    for r in rows:
        by_zoom.setdefault(r.zoom, {})[r.quadkey] = r["count"]
    assert by_zoom[0] == {"": 6} and all(sum(v.values()) == 6 for v in by_zoom.values())
    assert by_zoom[1] == {"0": 1, "1": 2, "2": 1, "3": 2}  # the last longitude wraps to the west, the origin is south-east
    for z in range(6):
        for key, n in by_zoom[z].items():
            assert n == sum(m for k, m in by_zoom[z + 1].items() if k.startswith(key))
    keys = {r.key for r in df.where("lat = 10.0 and lon = 20.0").select(agg.quadkey("lat", "lon", 3).alias("key")).collect()}
    assert keys == {"122"}

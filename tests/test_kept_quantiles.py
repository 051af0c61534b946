"""Kept quantiles equal sorting all values, read little, and follow new periods."""

import math
import random

import pytest

from riskloom.operators import kept_quantiles as kq

DDL = "period string, v double"


def want(values, q):
    s = sorted(values)
    at = q * (len(s) - 1)
    lo, hi = s[math.floor(at)], s[math.ceil(at)]
    return lo + (hi - lo) * (at - math.floor(at))


def test_equals_sorting_over_growing_periods(spark, tmp_path):
    rng, folder, kept = random.Random(2), str(tmp_path / "kept"), {}
    for period in ("2024-01", "2024-02", "2024-03"):
        kept[period] = [round(rng.lognormvariate(3, 1), 2) for _ in range(3000)] + [20.0] * 700
        rows = [(period, v) for v in kept[period]] + [(period, None), (period, math.nan), (None, 1.0)]
        kq.keep(spark.createDataFrame(rows, DDL), folder, "period", "v", files=12)
        values = [v for own in kept.values() for v in own]
        for q in (0.5, 0.95):
            assert kq.quantile(spark, folder, q) == pytest.approx(want(values, q), abs=1e-9)
    # a period that is kept again is replaced
    kq.keep(spark.createDataFrame([("2024-02", 1.0)] * 50, DDL), folder, "period", "v", files=12)
    kept["2024-02"] = [1.0] * 50
    values = [v for own in kept.values() for v in own]
    for q in (0.0, 0.37, 1.0):
        assert kq.quantile(spark, folder, q) == pytest.approx(want(values, q), abs=1e-9)
    # the bracket of a quantile touches few of the files
    files = kq.index(spark, folder).count()
    x = kq.quantile(spark, folder, 0.95)
    assert files > 20 and len(kq.overlapping(spark, folder, x * 0.97, x * 1.03)[1]) <= files // 4


def test_a_bracket_that_misses_is_widened(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(kq, "SKETCH_K", 8)  # a rough sketch
    folder, values = str(tmp_path / "kept"), [float(i * i % 7919) for i in range(4000)]
    kq.keep(spark.createDataFrame([("a", v) for v in values], DDL), folder, "period", "v", files=6)
    for q in (0.1, 0.77):
        assert kq.quantile(spark, folder, q, margin=0.0) == pytest.approx(want(values, q), abs=1e-9)


def test_small_tables(spark, tmp_path):
    kq.keep(spark.createDataFrame([], DDL), str(tmp_path / "a"), "period", "v")
    kq.keep(spark.createDataFrame([("x", 5.0)], DDL), str(tmp_path / "b"), "period", "v")
    assert kq.quantile(spark, str(tmp_path / "a"), 0.5) is None and kq.quantile(spark, str(tmp_path / "b"), 0.3) == 5.0

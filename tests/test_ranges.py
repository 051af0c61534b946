"""Nested and overlapping ranges, and the as-of merge, against plain loops."""

import random

import pytest

from riskloom.operators import joins as jn
from riskloom.operators import ranges as rg

RANGE = "lo long, hi long, name string"


def best(ranges, x):
    hit = [(hi - lo, -lo, name, lo, hi) for lo, hi, name in ranges if lo is not None and hi is not None and lo <= x <= hi]
    return (min(hit)[3], min(hit)[4], min(hit)[2]) if hit else None


def some_ranges(seed, n, top):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lo = rng.randrange(top)
        out.append((lo, min(top, lo + int(top * rng.random() ** 6)), f"r{i:03d}"))
    return out


CASES = [some_ranges(1, 60, 300), some_ranges(2, 200, 90), [(0, 99, "all"), (10, 19, "net"), (10, 19, "net"), (12, 12, "host")],
         [(5, 4, "empty"), (None, 9, "a"), (3, None, "b"), (7, 7, "one")], []]


@pytest.mark.parametrize("ranges", CASES)
@pytest.mark.parametrize("slices", [1, 5])
def test_pieces_are_disjoint_and_most_specific(spark, ranges, slices):
    pieces = rg.flatten_ranges(spark.createDataFrame(ranges, RANGE), "lo", "hi", slices=slices).collect()
    at = {}
    for p in pieces:
        for x in range(p.piece_lo, p.piece_hi + 1):
            assert x not in at
            at[x] = (p.lo, p.hi, p.name)
    assert at == {x: best(ranges, x) for x in range(-2, 310) if best(ranges, x)}


@pytest.mark.parametrize("ranges", CASES)
def test_both_joins_find_the_most_specific_range(spark, ranges):
    scale = 1 << 20  # so that ranges cross blocks
    wide = [(lo and lo * scale, hi and hi * scale, name) for lo, hi, name in ranges]
    rng = random.Random(9)
    facts = [(i, rng.choice([None, rng.randrange(0, 300 * scale), rng.randrange(0, 300) * scale, 17 * scale]), "x")
             for i in range(400)]
    df = spark.createDataFrame(facts, "id long, ip long, piece_lo string")
    dim = spark.createDataFrame(wide, RANGE)
    for how in ("left", "inner"):
        want = sorted(((i, *((best(wide, ip) if ip is not None else None) or (None,) * 3)) for i, ip, _ in facts
                       if how == "left" or (ip is not None and best(wide, ip))), key=repr)
        for strategy in ("blocks", "merge"):
            got = jn.ip_range_join(df, "ip", dim, "lo", "hi", how=how, strategy=strategy)
            assert got.columns == ["id", "ip", "piece_lo", "lo", "hi", "name"]
            assert sorted(((r.id, r.lo, r.hi, r.name) for r in got.collect()), key=repr) == want


def test_asof_join_carries_over_partitions(spark):
    rng = random.Random(4)
    rows = [(k, f"v{k}") for k in rng.sample(range(1000), 12)] + [(None, "no key")]
    facts = [(i, rng.choice([None, 500, rng.randrange(1000)])) for i in range(600)]  # one hot key
    got = rg.asof_join(spark.createDataFrame(facts, "id long, at long"), "at",
                       spark.createDataFrame(rows, "k long, v string"), "k", num_partitions=29).collect()
    keys = sorted(k for k, _ in rows if k is not None)
    for r in got:
        want = max((k for k in keys if r.at is not None and k <= r.at), default=None)
        assert (r.k, r.v) == (want, None if want is None else f"v{want}")
    assert sorted(r.id for r in got) == list(range(600))


def test_asof_join_of_empty_tables(spark):
    facts, rows = spark.createDataFrame([(1, 5)], "id long, at long"), spark.createDataFrame([], "k long, v string")
    assert [tuple(r) for r in rg.asof_join(facts, "at", rows, "k").collect()] == [(1, 5, None, None)]
    rows = spark.createDataFrame([(1, "a")], "k long, v string")
    assert rg.asof_join(facts.limit(0), "at", rows, "k").collect() == []


def test_merge_computes_the_facts_once(spark):
    """Partition bounds, the sort and the facts without a key come from one pass over the facts."""
    passes = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            passes.add(b.num_rows)
            yield b

    facts = spark.range(500).selectExpr("id", "IF(id % 5 = 0, NULL, id) AS ip").mapInArrow(counted, "id long, ip long")
    rows = spark.createDataFrame([(10 * i, f"r{i}") for i in range(40)], "start long, name string")
    found = rg.asof_join(facts, "ip", rows, "start", ["name"]).collect()
    assert {(r.id, r.name) for r in found} == {
        (i, None if i % 5 == 0 else f"r{min(i // 10, 39)}") for i in range(500)} and len(found) == 500
    assert passes.value == 500

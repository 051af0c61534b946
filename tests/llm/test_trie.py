import hashlib
import random
import zlib

import numpy as np
import pytest

from llm_fixtures import small_dir  # noqa: F401
from riskloom.llm import queries, trie

TURN = "conv_id long, turn long, role string, text string, key string, part int, path string, n long"


def brute(lists):
    """Nodes of {conv_id: [(role, text), ...]} by grouping every prefix."""
    nodes = {}
    for c, turns in lists:
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append((c, len(turns) == d))
    out = []
    for path, members in nodes.items():
        under = [p for p in nodes if p[:len(path)] == path]
        ends = ",".join(str(c) for c, stops in sorted(members) if stops)
        leaf = [p for p in under if not any(len(q) == len(p) + 1 and q[:-1] == p for q in nodes)]
        out.append((min(members)[0], len(path), min(nodes[path[:-1]])[0] if path else None, len(members),
                    sum(len(q) == len(path) + 1 for q in under), len(leaf),
                    sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in under if p),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def nodes_of(spark, lists):
    rows = [(c, d, r, t, "x", 7, "p", 1) for c, turns in lists for d, (r, t) in enumerate(turns)]
    df = trie.turn_lists(spark.createDataFrame(rows, TURN))
    empty = [c for c, turns in lists if not turns]
    if empty:
        df = df.unionByName(spark.createDataFrame([(c, []) for c in empty], df.schema))
    return sorted((tuple(r) for r in trie.prefix_trie(df).collect()), key=repr)


def some_lists(seed, n, words, depth):
    rng = random.Random(seed)
    return [(c, [(rng.choice("ua"), "é" * rng.randrange(words)) for _ in range(rng.randrange(depth + 1))])
            for c in rng.sample(range(10 * n), n)]


@pytest.mark.parametrize("lists", [
    some_lists(1, 120, 2, 5), some_lists(2, 60, 4, 3), some_lists(3, 80, 1, 12),
    [(5, [])], [(5, []), (3, [("u", "hello")])], [(9, [("u", "")]), (4, [("u", "")])],
    [(c, [("u", "same"), ("a", "yes")]) for c in range(50)] + [(99, [("u", "same")])],
    [(c, [("u", "x")] * (c + 1)) for c in range(30)]])
def test_equals_grouping_of_prefixes(spark, lists):
    assert nodes_of(spark, lists) == brute(lists)


def test_many_partitions_cut_nodes(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 23)
    try:
        lists = some_lists(4, 150, 2, 6) + [(100_000 + c, [("u", "hot")] * 4 + [("a", "y" * (c % 40))]) for c in range(80)]
        assert nodes_of(spark, lists) == brute(lists)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_nulls_ties_and_empty(spark):
    rows = [(1, None, "u", "first", "k", 1, "p", 1), (1, 0, None, None, "k", 1, "p", 1), (1, 0, None, None, "k", 1, "p", 1),
            (None, 0, "u", "no id", "k", 1, "p", 1), (2, None, "u", "first", "k", 1, "p", 1)]
    got = trie.prefix_trie(trie.turn_lists(spark.createDataFrame(rows, TURN))).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(
        [(1, [("u", "first"), ("", ""), ("", "")]), (2, [("u", "first")])])
    none = spark.createDataFrame([], TURN)
    assert trie.prefix_trie(trie.turn_lists(none)).collect() == []
    nulls = spark.createDataFrame([(3, None), (None, [("00" * 16, 1)])],
                                  "conv_id long, turns array<struct<key:string,chars:long>>")
    assert [tuple(r)[:4] for r in trie.prefix_trie(nulls).collect()] == [(3, 0, None, 1)]


def test_role_and_text_do_not_run_together(spark):
    lists = [(1, [("ab", "c")]), (2, [("a", "bc")]), (3, [("", "abc")]), (4, [("1:a", "")])]
    assert nodes_of(spark, lists) == brute(lists)


def test_long_end_group_is_hashed_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 7)
    lists = [(c, [("u", "same")]) for c in range(300)] + [(1000, [])]
    assert nodes_of(spark, lists) == brute(lists)


def test_extents_by_range_minima():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 17, 64, 100):
        lcp = rng.integers(0, 5, n)
        table = trie.RangeMin(lcp)
        row, depth = rng.integers(0, n, 200), rng.integers(0, 6, 200)
        left, right = table.left(row, depth), table.right(row, depth)
        for i, d, lo, hi in zip(row, depth, left, right):
            assert (lcp[lo + 1:i + 1] >= d).all() and (lo == 0 or lcp[lo] < d)
            assert (lcp[i + 1:hi + 1] >= d).all() and (hi == n - 1 or lcp[hi + 1] < d)
        lo, hi = np.minimum(left, right), np.maximum(left, right)
        assert table.least(lo, hi).tolist() == [lcp[a:b + 1].min() for a, b in zip(lo, hi)]


def test_query_on_the_table(spark, small_dir):
    rows = spark.read.parquet(f"{small_dir}/conversations.parquet").orderBy("conv_id", "turn").collect()
    own = {}
    for r in rows:
        own.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    lists = []
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        lists.append((c, own.get(c - c % 100, [])[:h] + turns[h:]))
    got = queries.op11_prefix_trie(spark, small_dir).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(lists)

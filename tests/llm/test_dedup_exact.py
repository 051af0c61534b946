import hashlib
from collections import defaultdict

import numpy as np
import pytest

from riskloom.llm import dedup_exact
from riskloom.llm.queries import QUERIES
from llm_fixtures import make_docs, small_dir, small_docs  # noqa: F401


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        first = True
        for i in sorted(ids, key=lambda i: (i is None, i)):
            kept = i == keep and first
            first = first and not kept
            out.append((i, keep, len(ids), kept, hashlib.sha256((t).encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (3, "a"), (None, "a"), (None, "q"), (None, "q"), (7, "a "),
        (8, "x" * 300_000), (9, "x" * 300_000), (10, "é"), (11, "é"), (2, "z"), (12, " \n\t")]


def test_edge_rows(make_docs):
    got = [tuple(r) for r in dedup_exact.exact_groups(make_docs(ROWS)).collect()]
    assert sorted(got, key=str) == brute(ROWS)


def test_query_equals_brute_force(spark, small_dir, small_docs):
    got = [tuple(r)[:5] for r in QUERIES["op1_exact_dedup"](spark, small_dir).collect()]
    assert sorted(got, key=str) == brute([r[:2] for r in small_docs])


def test_hot_text(make_docs):
    rows = [(i, "same") for i in range(3000)] + [(3000 + i, f"t{i}") for i in range(500)]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in dedup_exact.exact_groups(make_docs(rows)).collect()}
    assert got[0] == (2999, 3000, False) and got[2999] == (2999, 3000, True) and got[3001] == (3001, 1, True)


def test_empty(make_docs):
    docs = make_docs([])
    assert dedup_exact.exact_groups(docs).count() == 0
    assert dedup_exact.exact_dedup(docs).count() == 0


def test_dedup_keeps_one_row_of_each_group(make_docs):
    docs = make_docs(ROWS)
    out = dedup_exact.exact_dedup(docs)
    assert out.columns == docs.columns
    got = sorted([(r.doc_id, r.text or "") for r in out.collect()], key=str)
    expected = sorted([(i, dict_text) for i, dict_text in
                       {(r[0], next(t or "" for d, t in ROWS if hashlib.sha256((t or "").encode()).hexdigest() == r[4]))
                        for r in brute(ROWS) if r[3]}], key=str)
    assert got == expected


@pytest.mark.parametrize("capacity", [1.0, 10.0, 1e9])
def test_directory(capacity):
    rng = np.random.default_rng(1)
    weights = rng.random(1 << 8) * 3
    weights[17] = 500  # cannot be split: one prefix
    d = dedup_exact.Directory(weights, capacity)
    assert len(d.slots) == 1 << d.depth and max(d.local) == d.depth
    total = 0.0
    for b in range(len(d.local)):
        own = [i for i, s in enumerate(d.slots) if s == b]
        assert own == list(range(own[0], own[-1] + 1)) and len(own) == 1 << (d.depth - d.local[b])
        total += d.weight(b)
        assert d.weight(b) <= capacity or d.local[b] == 8
    assert total == pytest.approx(weights.sum())
    owners = d.owners(7)
    assert (np.diff(owners) >= 0).all() and owners.max() < 7


def test_chain_tells_colliding_texts_apart():
    """Two texts under one key: the bytes decide."""
    batch = dedup_exact.arrow_batch(dedup_exact.ENTRY, [
        np.zeros(4, np.int32), np.zeros(4, np.int32), np.full(4, 5), ["", "", "", ""], [1, 2, 3, 9], [1, 1, 2, 1],
        ["one", "two", "one", "two"]])
    (out,) = dedup_exact._own(iter([batch.slice(0, 2), batch.slice(2)]))
    assert sorted(zip(out["link"].to_pylist(), out["keep_id"].to_pylist(), out["group_size"].to_pylist())) == [
        (0, 3, 3), (1, 9, 2)]

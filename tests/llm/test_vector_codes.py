import hashlib
import math
import random

import numpy as np
import pytest

from llm_fixtures import small_dir  # noqa: F401
from riskloom.llm import queries, vector_codes

VEC = "vec_id long, embedding array<{}>, label int, code string, error string, whole string, of_label int"


def make(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, lab, "c", "e", "w", 1) for i, v, lab in rows], VEC.format(kind))


def brute(rows, parts=4, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[v[p * width:(p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            found = [near(c[p], books[p])[1] for c in cut]
            for k in set(found):
                own = [c[p] for c, f in zip(cut, found) if f == k]
                books[p][k] = [sum(col) // len(own) for col in zip(*own)]
    out = []
    for (i, _, lab), c in zip(kept, cut):
        hits = [near(c[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in hits), sum(d for d, _ in hits), lab))
    labels = {}
    for r in out:
        labels[r[3]] = labels.get(r[3], 0) + r[2]
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted([(i, c, e, labels[lab]) for i, c, e, lab in out], key=repr), digest


def coded(df, **more):
    codes = vector_codes.encode_vectors(df, **more)
    rows = vector_codes.with_label_errors(codes.rows).selectExpr("vec_id", "lower(hex(code))", "error", "label_error")
    return sorted((tuple(r) for r in rows.collect()), key=repr), codes.digest()


def cloud(seed, n, dim, spread=1.0):
    rng = random.Random(seed)
    return [(i, [spread * rng.gauss(0, 0.1) for _ in range(dim)], rng.choice([None, 1, 2])) for i in range(n)]


@pytest.mark.parametrize("rows,entries", [
    (cloud(1, 300, 8), 256), (cloud(2, 120, 8), 5), (cloud(3, 3, 4), 256), ([(7, [0.5] * 4, None)], 2),
    ([(i, [float(i % 3)] * 4, 1) for i in range(40)], 8),                       # equal entries: ties to the lower index
    ([(i, [-0.0001 * i] * 8, i) for i in range(30)], 3),                        # all floors go down
    (cloud(4, 30, 8, 1e6), 4), (cloud(5, 30, 8, 1e12), 4)])                    # wider than doubles and than 64 bits hold
def test_equals_plain_lloyd(spark, rows, entries):
    want, digest = brute(rows, entries=entries)
    want = [(i, c, e if e < 1 << 63 else None, t if t < 1 << 63 else None) for i, c, e, t in want]
    got, found = coded(make(spark, rows), entries=entries)
    if any(e is None for _, _, e, _ in want):
        got, want = [r[:3] for r in got], [r[:3] for r in want]
    assert (got, found) == (want, digest)


def test_floats_nulls_and_repeats(spark):
    rows = cloud(6, 60, 8)
    rows = [(i, [float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    bad = [(900, None, 1), (901, [None] + [0.1] * 7, 1), (902, [math.nan] * 8, 2), (903, [math.inf] + [0.0] * 7, None)]
    rows += rows[:5] + [(None, [0.25] * 8, None)]
    assert coded(make(spark, rows + bad, "float"), entries=9) == brute(rows, entries=9)


def test_another_length_stays_without_a_code(spark):
    rows = cloud(7, 20, 8)
    want, digest = brute(rows, entries=4)
    got, found = coded(make(spark, rows + [(500, [1.0] * 4, 99), (501, [], 99)]), entries=4)
    assert found == digest and [r for r in got if r[0] < 500] == want
    assert [r for r in got if r[0] >= 500] == [(500, None, None, None), (501, None, None, None)]


def test_empty_and_uncuttable(spark):
    for rows in ([], [(1, None, 1)]):
        got, digest = coded(make(spark, rows))
        assert got == [] and digest == hashlib.sha256(b"").hexdigest()
    with pytest.raises(ValueError):
        vector_codes.encode_vectors(make(spark, [(1, [1.0] * 6, 1)]))


def test_active_entries_equal_a_full_scan():
    rng = np.random.default_rng(8)
    for trial in range(40):
        rows = rng.integers(-4, 5, (200, 3)).astype(float)
        book = rng.integers(-4, 5, (17, 3)).tolist()
        code, d = vector_codes.assign(rows, book, np.ones(17, bool), np.zeros(200, int), np.full(200, -1))
        moved = rng.random(17) < (trial % 5) / 4
        new = [[int(x) for x in rng.integers(-4, 5, 3)] if m else e for e, m in zip(book, moved)]
        got = vector_codes.assign(rows, new, moved, code, np.array(d))
        want = vector_codes.assign(rows, new, np.ones(17, bool), code * 0, np.full(200, -1))
        assert got[0].tolist() == want[0].tolist() and got[1] == want[1]


def test_fixed_parts_look_at_moved_entries_only(monkeypatch):
    seen = []
    plain = vector_codes.distances
    monkeypatch.setattr(vector_codes, "distances", lambda r, e: seen.append((len(r), len(e))) or plain(r, e))
    rows = np.arange(12, dtype=float).reshape(12, 1)
    moved = np.array([False, True, False])
    vector_codes.assign(rows, [[0], [5], [10]], moved, np.array([0] * 4 + [1] * 4 + [2] * 4), np.zeros(12, int))
    assert seen == [(4, 3), (8, 1)]


def test_query_on_the_table(spark, small_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{small_dir}/embeddings.parquet").collect()]
    want, digest = brute(rows)
    got = queries.op13_vector_codes(spark, small_dir).collect()
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=repr) == want
    assert {r.codebooks_sha256 for r in got} == {digest}

import random
import re

import numpy as np
import pytest
import xxhash

from riskloom.llm import simhash
from riskloom.llm.components import components
from riskloom.llm.queries import QUERIES
from llm_fixtures import make_docs, small_dir, small_docs  # noqa: F401


def brute_fingerprint(text):
    data = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    if not words:
        return 0
    parts = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """node -> smallest index reachable."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def brute(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    comp = brute_components(fps)
    least = {}
    for (i, _), c in zip(rows, comp):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    return sorted(((i, f"{f:016x}", least.get(c)) for (i, _), f, c in zip(rows, fps, comp)), key=str)


@pytest.mark.parametrize("text", ["", None, " \t\n", "One", "one two", "ONE two\x0bthree", "a b c d", "É é É é",
                                  "x " * 70_000, "a b c d", "w" * 100_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text or "") == brute_fingerprint(text)


def test_query_equals_brute_force(spark, small_dir, small_docs):
    got = [tuple(r) for r in QUERIES["op10_simhash"](spark, small_dir).collect()]
    assert sorted(got, key=str) == brute([r[:2] for r in small_docs])


def test_near_copies(make_docs):
    rng = random.Random(5)
    words = ["w%d" % i for i in range(400)]
    base = [rng.choice(words) for _ in range(600)]
    rows = [(100 + i, " ".join(base[:i * 3] + ["new%d" % i] + base[i * 3 + 1:])) for i in range(60)]
    rows += [(i, " ".join(rng.choice(words) for _ in range(80))) for i in range(40)]
    rows += [(5, None), (200, ""), (None, ""), (6, rows[3][1]), (6, rows[3][1])]
    got = [tuple(r) for r in simhash.near_groups(make_docs(rows)).collect()]
    assert sorted(got, key=str) == brute(rows)
    kept = simhash.near_dedup(make_docs(rows))
    assert kept.columns == make_docs(rows).columns
    least = {(i, c) for i, _, c in brute(rows)}
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(
        (i for i, _ in rows if i is None or (i, i) in least), key=str)


def _linked(spark, fps, big, monkeypatch):
    monkeypatch.setattr(simhash, "BIG", big)
    nodes = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in sorted(fps)], "fp long")
    roots = {r.node: r.root for r in components(simhash.links(nodes)).collect()}
    return [roots.get(int(np.uint64(f).view(np.int64)), int(np.uint64(f).view(np.int64))) for f in sorted(fps)]


@pytest.mark.parametrize("big", [2048, 5])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, big):
    """Chains and clouds around centres: no component is lost or joined, with and without refined cells."""
    rng = random.Random(big)
    fps = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(40):
            fps.add(x)
            for _ in range(rng.choice([1, 2, 3, 4, 6])):
                x ^= 1 << rng.randrange(64)
    fps = sorted(fps)
    got, expected = _linked(spark, fps, big, monkeypatch), brute_components(fps)
    pairs = {(g, e) for g, e in zip(got, expected)}
    assert len(pairs) == len(set(got)) == len(set(expected))


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(200, 260)] + [(1, 2), (2, 3), (3, 1), (9, 9)]
    rows = spark.createDataFrame(edges + edges[:5], "u long, v long")
    got = {r.node: r.root for r in components(rows).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 7 for i in [7, *range(200, 260)])
    assert got[1] == got[2] == got[3] == 1 and 9 not in got
    assert components(rows.where("false")).count() == 0


def test_empty(make_docs):
    assert simhash.near_groups(make_docs([])).count() == 0
    assert simhash.near_dedup(make_docs([])).count() == 0

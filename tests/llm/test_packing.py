import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riskloom.llm import packing
from riskloom.llm.queries import QUERIES
from riskloom.llm.tokens import vocabulary
from llm_fixtures import make_docs, small_dir, small_docs  # noqa: F401


def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(vocabulary("word_bpe_49k.json"))


def check(rows, got, capacity=2048):
    lib, expected = library(), Counter()
    for i, t, *_ in rows:
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        for p, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at:at + capacity]
            expected[i, p, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == expected
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_query(spark, small_dir, small_docs):
    got = [r.asDict() for r in QUERIES["op5_packing"](spark, small_dir).collect()]
    bins = check(small_docs, got)
    assert bins <= 1.02 * sum(r["length"] for r in got) / 2048 + 1


ROWS = [(1, None), (2, ""), (3, "word " * 5000), (4, "a b c"), (4, "a b c"), (None, "x"), (5, "it's <|endoftext|> É é ﬁ"),
        (6, " \n\t "), (7, "Ünï-cödé 中文 12.5"), (8, "z" * 50_000)]


def test_edge_rows(make_docs):
    from pyspark.sql import functions as F
    for capacity in (2048, 8):
        got = packing.pack(make_docs(ROWS), capacity=capacity).withColumn("ids_crc32", F.crc32("ids")).collect()
        check(ROWS, [r.asDict() for r in got], capacity)
    assert packing.pack(make_docs([])).count() == 0


def optimum(lengths, capacity):
    """Fewest bins, by search."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for b in {room: k for k, room in enumerate(bins)}.values():
            if bins[b] >= lengths[i]:
                place(i + 1, bins[:b] + [bins[b] - lengths[i]] + bins[b + 1:])
        place(i + 1, bins + [capacity - lengths[i]])
    place(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_reduction_keeps_an_optimum(lengths):
    counts = Counter(lengths)
    fixed, rest = packing.reduce_dominated(counts, 20)
    used = Counter()
    for pattern, n in fixed:
        assert sum(pattern) <= 20
        for w in pattern:
            used[w] += n
    assert used + Counter(rest) == counts
    left = [w for w, n in rest.items() for _ in range(n)]
    assert sum(n for _, n in fixed) + optimum(left, 20) == optimum(lengths, 20)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_patterns_hold_every_piece(lengths):
    patterns = packing.pack_lengths(Counter(lengths), 50)
    used = Counter()
    for pattern, n in patterns:
        assert sum(pattern) <= 50 and n > 0
        for w in pattern:
            used[w] += n
    assert used == Counter(lengths)
    plain = packing.best_fit(Counter(lengths), 50)
    rooms = []
    for w in sorted(lengths, reverse=True):  # piece by piece
        fit = [r for r in rooms if r >= w]
        if fit:
            rooms.remove(min(fit))
        rooms.append((min(fit) if fit else 50) - w)
    assert sum(n for _, n in plain) == len(rooms)


@pytest.mark.parametrize("counts", [{2048: 10 ** 9, 1: 10 ** 9, 2047: 10 ** 6}, {1024: 3}, {1: 5000}])
def test_large_counts(counts):
    patterns = packing.pack_lengths(counts, 2048)
    assert sum(n * sum(p) for p, n in patterns) == sum(w * n for w, n in counts.items())

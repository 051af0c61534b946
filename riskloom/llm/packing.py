"""Best-fit packing after Martello-Toth dominance reduction.

Documents become token pieces of at most ``capacity`` tokens; only longer
documents are cut.  Lengths are whole numbers up to the capacity, so the
instance is a histogram with a count per length, whatever the number of
pieces.  The reduction fixes small sets (a piece with none, one or two others)
that dominate every other way to use the piece: some optimal packing contains
them.  Pieces fixed so leave the instance; the remainder is packed best-fit in
decreasing length.  The result is a table of bin patterns with multiplicities,
in which the n-th piece of a length has a known place; pieces get their rank
from counts per scan task, so no piece travels to another to be packed.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import save, text_of
from .tokens import encoder, vocabulary

Pattern = tuple[tuple[int, ...], int]  # lengths in a bin, number of such bins


class _Lengths:
    """Counts per length, with the lengths present in order."""

    def __init__(self, counts: dict[int, int]):
        self.count = Counter({k: v for k, v in counts.items() if v > 0})
        self.keys = sorted(self.count)

    def take(self, lengths: tuple[int, ...], times: int) -> None:
        for w in lengths:
            self.count[w] -= times
            if not self.count[w]:
                del self.count[w]
                self.keys.pop(bisect_left(self.keys, w))

    def largest(self, limit: int, without: tuple[int, ...] = ()) -> int:
        """The largest length up to ``limit`` left when ``without`` is taken out; 0 if none."""
        i = bisect_right(self.keys, limit) - 1
        while i >= 0 and self.count[self.keys[i]] <= without.count(self.keys[i]):
            i -= 1
        return self.keys[i] if i >= 0 else 0

    def smallest(self, n: int, over: int, without: tuple[int, ...]) -> list[int]:
        """The ``n`` smallest pieces longer than ``over`` left when ``without`` is taken out."""
        out, i = [], bisect_right(self.keys, over)
        while i < len(self.keys) and len(out) < n:
            out += [self.keys[i]] * max(0, min(n - len(out), self.count[self.keys[i]] - without.count(self.keys[i])))
            i += 1
        return out


def _dominant(items: _Lengths, j: int, capacity: int) -> tuple[int, ...] | None:
    """A set with ``j`` that dominates all sets with ``j``, if the criterion finds one."""
    room = capacity - j
    first = items.largest(room, (j,))
    if not first:
        return (j,)                                     # nothing fits beside it
    if first == room:
        return (j, first)                               # one piece in place of any others
    least = items.smallest(3, 0, (j,))
    if len(least) < 2 or least[0] + least[1] > room:
        return (j, first)                               # at most one other fits: the largest
    if len(least) > 2 and sum(least) <= room:
        return None                                     # three others may fit
    pair = _best_pair(items, j, room)
    if first >= pair:
        return (j, first)                               # one piece in place of any two
    second = items.largest(room - first, (j, first))
    if not second:
        return None
    # two pieces {first, second} in place of any two: none may have both, each longer than ``second``, beside ``first``
    over = items.smallest(2, second, (j,))
    if len(over) < 2 or sum(over) > room:
        return (j, first, second)
    return None


def _best_pair(items: _Lengths, j: int, room: int) -> int:
    """Largest sum of two other pieces within ``room``."""
    left = lambda w: items.count[w] - (w == j)
    keys = [w for w in items.keys if left(w) > 0]
    best, lo, hi = 0, 0, len(keys) - 1
    while lo <= hi:
        a, b = keys[lo], keys[hi]
        if a + b > room:
            hi -= 1
            continue
        if a != b or left(a) > 1:
            best = max(best, a + b)
        lo += 1
    return best


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Fix dominating sets, largest piece first, until a pass finds none: (fixed patterns, remaining counts)."""
    items, fixed, found = _Lengths(counts), [], True
    while found:
        found = False
        for j in sorted(items.count, reverse=True):
            while items.count.get(j, 0):
                chosen = _dominant(items, j, capacity)
                if chosen is None:
                    break
                # the criterion still holds while the same pieces are there
                times = min(items.count[w] // n for w, n in Counter(chosen).items())
                items.take(chosen, times)
                fixed.append((chosen, times))
                found = True
    return fixed, dict(items.count)


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit in decreasing length over counts: bins of equal contents are one entry."""
    open_: dict[int, list[list]] = {}  # room left -> [contents as runs, bins]
    rooms: list[int] = []

    def put(room: int, contents: tuple, bins: int) -> None:
        if bins:
            if room not in open_:
                insort(rooms, room)
                open_[room] = []
            open_[room].append([contents, bins])

    for w in sorted(counts, reverse=True):
        left = counts[w]
        at = bisect_left(rooms, w)
        todo = rooms[at:]
        filled = []
        for room in todo:  # tightest first; a bin is filled before the next one is touched
            if not left:
                break
            each, groups = room // w, open_.pop(room)
            rooms.pop(bisect_left(rooms, room))
            keep = []
            for contents, bins in groups:
                full = min(bins, left // each)
                left -= full * each
                filled.append((room - each * w, contents + ((w, each),), full))
                if full < bins and left:
                    filled.append((room - left * w, contents + ((w, left),), 1))
                    left, full = 0, full + 1
                if full < bins:
                    keep.append([contents, bins - full])
            if keep:
                insort(rooms, room)
                open_[room] = keep
        if left:
            each = capacity // w
            filled.append((capacity - each * w, ((w, each),), left // each))
            if left % each:
                filled.append((capacity - left % each * w, ((w, left % each),), 1))
        for room, contents, bins in filled:
            put(room, contents, bins)
    return [(tuple(w for w, n in contents for _ in range(n)), bins)
            for groups in open_.values() for contents, bins in groups]


def pack_lengths(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns of bins that hold every piece of the histogram: dominance reduction, then best fit."""
    fixed, rest = reduce_dominated(counts, capacity)
    return fixed + best_fit(rest, capacity)


#: Characters cut and bytes of ids held at once: small, as stages before this one leave executors nearly full.
TOGETHER, HELD = 2 << 20, 4 << 20
PIECE = "doc_id long, task int, no long, piece int, start long, length int, nth long, ids binary"


def pieces(docs: DataFrame, vocab: str, capacity: int = 2048, end_id: int = 0, text: str = "text",
           doc_id: str = "doc_id") -> DataFrame:
    """Token pieces of every row of ``docs``, written to the shared folder with their ids (little-endian uint32):
    ``task`` and ``nth`` are the scan task and the rank among its pieces of the same length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(vocab), int(end_id).to_bytes(4, "little")
        task, ranks, no = TaskContext.get().partitionId(), Counter(), 0
        names = ["doc_id", "task", "no", "piece", "start", "length", "nth", "ids"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        for b in batches:
            out: list[tuple] = []
            held = 0
            for doc, own in zip(b.column("doc_id"), enc.ids_of((t.as_py() for t in b.column("text")), TOGETHER),
                                strict=True):
                ids = own + end
                for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    n = len(part) // 4
                    out.append((doc.as_py(), task, no, p, at // 4, n, ranks[n], part))
                    ranks[n] += 1
                    held += len(part)
                no += 1
                if held > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return save(docs.select(docs[doc_id].cast("long").alias("doc_id"), text_of(docs, text).alias("text")).mapInArrow(
        run, PIECE), "pieces")


def pack(docs: DataFrame, vocab: str | None = None, capacity: int = 2048, end_id: int = 0, text: str = "text",
         doc_id: str = "doc_id") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (binary), sequence_id, offset.

    A document is its ids and ``end_id``; null text counts as empty and still
    has the end id.  Repeated rows are separate documents.  Pieces of a
    sequence lie without gaps from 0.  An empty table gives no rows.
    """
    cut = pieces(docs, vocab or vocabulary("word_bpe_49k.json"), capacity, end_id, text, doc_id)
    per_task = save(cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    patterns = pack_lengths(counts, capacity)  # at most ``capacity`` counts in

    # runs of places: pieces of a length with ranks from ``begin`` go to bins first_bin, first_bin + 1, ... at ``offset``
    used, runs, first_bin = Counter(), {}, 0
    for lengths, bins in patterns:
        offset = 0
        for w in lengths:
            runs.setdefault(w, []).append((used[w], first_bin, offset))
            used[w] += bins
            offset += w
        first_bin += bins
    places = {w: tuple(np.array(c, np.int64) for c in zip(*r)) for w, r in runs.items()}

    base = per_task.withColumn("base", F.sum("n").over(
        Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = cut.join(base.select("task", "length", F.coalesce("base", F.lit(0)).alias("base")), ["task", "length"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column("length").to_numpy()
            rank = b.column("base").to_numpy() + b.column("nth").to_numpy()
            bins, offsets = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for w in np.unique(length).tolist():
                rows = np.flatnonzero(length == w)
                begin, first, offset = places[w]
                run = np.searchsorted(begin, rank[rows], side="right") - 1
                bins[rows] = first[run] + rank[rows] - begin[run]
                offsets[rows] = offset[run]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("piece"), b.column("start"), b.column("length").cast(pa.int64()),
                 b.column("ids"), pa.array(bins), pa.array(offsets)],
                names=["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"])

    return ranked.mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long")

"""SimHash near-dedup with pivot distance tables.

Each distinct fingerprint gets a table of its Hamming distances to reference
fingerprints: zero, the 64 single bits, and ``SPREAD`` fixed ones spread over
the space.  By the triangle inequality two fingerprints within ``k`` bits
differ by at most ``k`` in every coordinate, so a pair whose maximum
coordinate difference is larger is discarded, and survivors are verified.

Not every pair is laid out for that.  The distances to the single bits of a
segment, taken against the distance to zero, are equal for two fingerprints
exactly when they agree on the segment; ``k <= 3`` differing bits leave at
least 3 of 6 segments alone.  So pairs are only compared inside cells: equal
coordinates on one of the 20 choices of 3 segments.  A cell above ``BIG``
fingerprints is refined the same way over its free bits; then at most 2^16
distinct fingerprints share a cell.  Inside a cell a search from each reached
fingerprint over those not reached yet gives a spanning forest, never all
pairs.  Union-find over these links gives the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import arrow_batch, save, text_of

BIG = 2048
SPREAD = 16
_REFERENCES = np.concatenate([
    np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64),
    np.array([xxhash.xxh64_intdigest(b"reference %d" % i) for i in range(SPREAD)], np.uint64)])


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all word shingles; ASCII lower case; no words: 0."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # splits at space and \x09-\x0D only
    if not words:
        return 0
    width = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:len(words) - width + 1].tolist()
    ends = ends[width - 1:].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), 1 << 16):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at:at + (1 << 16)], ends[at:at + (1 << 16)])],
                     "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    over = np.packbits(counts * 2 > len(starts), bitorder="little")
    return int(over.view("<u8")[0])


FP = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
CELL = pa.schema([("cell", pa.int64()), ("fp", pa.int64())])
EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, text: str = "text",
                 doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp long) for every row; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py(), shingle, seed) for t in b.column("text")]
            yield arrow_batch(FP, [b.column("doc_id"), np.array(fps, np.uint64).view(np.int64)])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), text_of(docs, text).alias("text")).mapInArrow(
        run, "doc_id long, fp long")


def distance_table(fps: np.ndarray) -> np.ndarray:
    """(n, references) Hamming distances of uint64 fingerprints."""
    return np.bitwise_count(fps[:, None] ^ _REFERENCES[None, :]).astype(np.int8)


def _segment_bits(table: np.ndarray) -> np.ndarray:
    """Bits told by coordinates: d(x, bit i) is d(x, 0) + 1 without the bit and d(x, 0) - 1 with it."""
    return (table[:, 1:65] < table[:, :1]).astype(np.uint8)


def _cells(bits: np.ndarray, segments: list[np.ndarray], intact: int, base: np.ndarray) -> np.ndarray:
    """(n, choices) cell numbers; a collision of two cells only adds pairs that verification drops."""
    out = []
    for c, choice in enumerate(combinations(range(len(segments)), intact)):
        cols = bits[:, np.concatenate([segments[s] for s in choice])]
        packed = np.packbits(np.pad(cols, ((0, 0), (0, 64 - cols.shape[1]))), axis=1)
        key = np.ascontiguousarray(packed).view("<u8")[:, 0]
        with np.errstate(over="ignore"):
            key = (key ^ (base * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(c + 1)
            key ^= key >> np.uint64(32)
            key = key * np.uint64(0xD6E8FEB86659FD93) + np.uint64(c + 1)
        out.append(key)
    return np.stack(out, axis=1)


def _lay_out(max_bits: int, pieces: int):
    """Fingerprints -> a row per choice of segments that may be untouched."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column("fp").to_numpy().view(np.uint64)
            bits = _segment_bits(distance_table(fps))
            cells = _cells(bits, np.array_split(np.arange(64), pieces), pieces - max_bits, np.zeros(len(fps), np.uint64))
            yield arrow_batch(CELL, [cells.ravel().view(np.int64), np.repeat(fps, cells.shape[1]).view(np.int64)])
    return run


def _refine(max_bits: int, pieces: int):
    """Members of a large cell -> finer cells over all bits in another order of segments.

    The first layout fixed contiguous segments; here segments take every 6th
    bit, so with any first choice half of each fixed bit set is new.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column("fp").to_numpy().view(np.uint64)
            bits = _segment_bits(distance_table(fps))
            cells = _cells(bits, [np.arange(i, 64, pieces) for i in range(pieces)], pieces - max_bits,
                           b.column("cell").to_numpy().view(np.uint64))
            yield arrow_batch(CELL, [cells.ravel().view(np.int64), np.repeat(fps, cells.shape[1]).view(np.int64)])
    return run


def _forest(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of one cell: search from reached fingerprints over the rest."""
    table, rest, links = distance_table(fps), np.arange(len(fps)), []
    todo = []
    while len(rest) or todo:
        if not todo:
            todo, rest = [rest[0]], rest[1:]
        x = todo.pop()
        near = rest
        for c in (0, *range(65, table.shape[1])):  # coordinate by coordinate, over the pairs that survive
            near = near[np.abs(table[near, c] - table[x, c]) <= max_bits]
        near = near[np.bitwise_count(fps[near] ^ fps[x]) <= max_bits]
        if len(near):
            links += [(int(x), int(y)) for y in near]
            todo += near.tolist()
            rest = np.setdiff1d(rest, near, assume_unique=True)
    return links


def _verify(max_bits: int):
    """Rows in cell order -> links of at most ``max_bits`` differing bits."""
    def pairs(cells: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(cells)]]))
        us, vs = [], []
        small = sizes <= 8
        member = np.repeat(small, sizes)
        where = np.flatnonzero(member)
        c, f = cells[where], fps[where]
        for step in range(1, 8):
            if len(c) <= step:
                break
            i = np.flatnonzero(c[step:] == c[:-step])
            if not len(i):
                break
            a, b = distance_table(f[i]), distance_table(f[i + step])
            i = i[np.abs(a - b).max(axis=1) <= max_bits]
            i = i[np.bitwise_count(f[i] ^ f[i + step]) <= max_bits]
            us.append(f[i])
            vs.append(f[i + step])
        for s, n in zip(starts[~small].tolist(), sizes[~small].tolist()):
            group = fps[s:s + n]
            links = np.array(_forest(group, max_bits), np.int64).reshape(-1, 2)
            us.append(group[links[:, 0]])
            vs.append(group[links[:, 1]])
        if us:
            edges = np.unique(np.stack([np.concatenate(us), np.concatenate(vs)], axis=1), axis=0)
            yield arrow_batch(EDGE, [edges[:, 0].copy().view(np.int64), edges[:, 1].copy().view(np.int64)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for b in batches:
            cells = np.concatenate([cells, b.column("cell").to_numpy()])
            fps = np.concatenate([fps, b.column("fp").to_numpy().view(np.uint64)])
            if len(cells) and cells[0] != cells[-1]:  # all but the last cell are whole
                cut = int(np.searchsorted(cells, cells[-1]))
                yield from pairs(cells[:cut], fps[:cut])
                cells, fps = cells[cut:], fps[cut:]
        if len(cells):
            yield from pairs(cells, fps)

    return run


def links(nodes: DataFrame, max_bits: int = 3) -> DataFrame:
    """``nodes(fp)`` distinct -> links (u, v) that connect all fingerprints
    connected by pairs of at most ``max_bits`` differing bits."""
    pieces = 2 * max_bits
    cells = save(nodes.select("fp").mapInArrow(_lay_out(max_bits, pieces), "cell long, fp long"), "cells")
    shared = save(cells.groupBy("cell").count().where("count > 1"), "cell-sizes")
    large = shared.where(F.col("count") > BIG).select("cell")
    parts = [cells.join(shared.where(F.col("count") <= BIG).select("cell"), "cell")]
    if not large.isEmpty():
        parts.append(cells.join(large, "cell").select("fp", "cell").mapInArrow(
            _refine(max_bits, pieces), "cell long, fp long"))
    out = None
    for part in parts:
        edges = part.select("cell", "fp").repartition("cell").sortWithinPartitions("cell").mapInArrow(
            _verify(max_bits), "u long, v long")
        out = edges if out is None else out.unionByName(edges)
    return out


def near_groups(docs: DataFrame, shingle: int = 3, max_bits: int = 3, seed: int = 42, text: str = "text",
                doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits),
    component_id (smallest doc_id reachable over links of at most ``max_bits``
    bits, itself included; null ids are passed over).

    Repeated rows and equal texts share a fingerprint; empty and null texts
    have fingerprint 0 and link like any other.  An empty table gives no rows;
    other columns are ignored.
    """
    fps = save(fingerprints(docs, shingle, seed, text, doc_id), "fingerprints")
    nodes = save(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes, max_bits)).withColumnRenamed("node", "fp")
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, shingle: int = 3, max_bits: int = 3, seed: int = 42, text: str = "text",
               doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of each group, all columns.
    Rows without doc_id stay; of repeated doc_ids all stay or go together."""
    groups = near_groups(docs, shingle, max_bits, seed, text, doc_id)
    lost = save(groups.groupBy(F.col("doc_id").alias("__id")).agg(F.min(F.col("component_id")).alias("least"))
                .where("least < __id").select("__id"), "near")
    return docs.join(lost, docs[doc_id].cast("long") == lost["__id"], "left_anti")

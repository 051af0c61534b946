"""Prefix trie of turn sequences from sorted LCPs.

Every turn is a 128-bit key, a conversation the bytes of its keys.  Equal
sequences collapse first, so no group of copies is ever sorted; the distinct
ones are sorted over range partitions.  The LCP of neighbours (in turns)
and a sparse table of range minima over them answer each candidate prefix
(row, depth) on its own: its member interval is found by binary search to the
left and to the right over the minima, without any stack.  All node values are
prefix sums or range minima over the interval.

An interval that crosses a partition's edge gives one partial row per
partition, known by the hash of the prefix; partials add up afterwards.  Only
the prefixes of a partition's first and last row can cross.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import partitions, save, ship_package

KEY = 16
#: Ids of one end group that are joined to a block of text.
BLOCK = 1 << 16
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_lists(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
               text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, turns (array of key and chars) by turn, null first; ties by key.

    A key is 128 bits of the SHA-256 of role and text (the role's length goes
    before it); null role or text counts as empty.  Rows without a
    conversation id belong to no conversation.  Texts do not move: a turn is
    its key and its code points, and a conversation is one row of those.
    """
    who, what = (F.coalesce(turns[c].cast("string"), F.lit("")) for c in (role, text))
    key = F.substring(F.sha2(F.concat(F.length(who).cast("string"), F.lit(":"), who, what), 256), 1, 2 * KEY)
    rows = turns.select(turns[conv_id].cast("long").alias("conv_id"), F.struct(
        turns[turn].alias("turn"), key.alias("key"), F.length(what).cast("long").alias("chars")).alias("t"))
    return rows.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t")).select(
        "conv_id", F.transform("t", lambda t: F.struct(t["key"].alias("key"), t["chars"].alias("chars"))).alias("turns"))


# ------------------------------------------------------------ who ends where


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of (seq, conv_id) in order -> blocks of comma-joined ids."""
    seq, ids = None, []

    def block() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"seq": [seq], "first": [ids[0]], "last": [ids[-1]],
                                           "ids": [",".join(map(str, ids))]})

    out, held = [], 0
    for b in batches:
        for s, i in zip(b.column("seq").to_pylist(), b.column("conv_id").to_pylist(), strict=True):
            if ids and (s != seq or len(ids) >= BLOCK):
                out.append(block())
                held += len(ids)
                ids = []
                if held > 4 * BLOCK or len(out) > 4096:
                    yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
                    out, held = [], 0
            seq = s
            ids.append(i)
    if ids:
        out.append(block())
    if out:
        yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]


def _end_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a sequence in order -> the SHA-256 of all its ids, fed block by block."""
    seq, sha = None, None
    for b in batches:
        out = []
        for s, ids in zip(b.column("seq").to_pylist(), b.column("ids").to_pylist(), strict=True):
            if s != seq:
                if sha:
                    out.append((seq, sha.hexdigest()))
                seq, sha = s, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["seq", "ends"])
    if sha:
        yield pa.RecordBatch.from_pydict({"seq": [seq], "ends": [sha.hexdigest()]})


def _ends(members: DataFrame) -> DataFrame:
    """(seq, ends): ids are sorted over ranges of (sequence, id), so a large group is split, and leave as blocks."""
    n = partitions(members.sparkSession)
    blocks = members.select("seq", "conv_id").repartitionByRange(n, "seq", "conv_id").sortWithinPartitions(
        "seq", "conv_id").mapInArrow(_blocks, "seq binary, first long, last long, ids string")
    return blocks.repartition(n, "seq").sortWithinPartitions("seq", "first", "last").mapInArrow(
        _end_hashes, "seq binary, ends string")


# ------------------------------------------------------------ intervals


class RangeMin:
    """Sparse table: minima of all runs whose length is a power of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 * (1 << (len(self.levels) - 1)) <= len(values):
            a, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(a[:-half], a[half:]))

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minimum of [lo, hi], both included."""
        k = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
        out = np.empty(len(lo), self.levels[0].dtype)
        for level in np.unique(k).tolist():
            at, a = k == level, self.levels[level]
            out[at] = np.minimum(a[lo[at]], a[hi[at] - (1 << level) + 1])
        return out

    def right(self, row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Last row r such that the values of row+1 .. r are all at least ``depth``."""
        n, r = len(self.levels[0]), row.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            a, can = self.levels[k], r + (1 << k) < n
            go = can & (a[np.where(can, r + 1, 0)] >= depth)
            r[go] += 1 << k
        return r

    def left(self, row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """First row l such that the values of l+1 .. row are all at least ``depth``."""
        l = row.copy()  # noqa: E741
        for k in range(len(self.levels) - 1, -1, -1):
            a, can = self.levels[k], l - (1 << k) >= 0
            go = can & (a[np.where(can, l - (1 << k) + 1, 0)] >= depth)
            l[go] -= 1 << k
        return l


def shared_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b)) // KEY
    x, y = (np.frombuffer(v, np.uint64, 2 * n).reshape(n, 2) for v in (a, b))
    differ = np.flatnonzero((x != y).any(1))
    return int(differ[0]) if len(differ) else n


def _neighbour_lcps(keys: np.ndarray, offset: np.ndarray, length: np.ndarray) -> np.ndarray:
    """LCP of every row with the row before it (row 0: 0), one depth at a time over the pairs that still agree."""
    lcp = np.zeros(len(length), np.int64)
    pairs, depth = np.arange(1, len(length)), 0
    while len(pairs):
        pairs = pairs[(length[pairs - 1] > depth) & (length[pairs] > depth)]
        pairs = pairs[(keys[offset[pairs - 1] + depth] == keys[offset[pairs] + depth]).all(1)]
        depth += 1
        lcp[pairs] = depth
    return lcp


def _prefix_keys(path: bytes) -> list[bytes]:
    """Hash of every prefix of a row, from no turn on."""
    sha = hashlib.sha256()
    out = [sha.digest()[:KEY]]
    for at in range(0, len(path), KEY):
        sha.update(path[at:at + KEY])
        out.append(sha.copy().digest()[:KEY])
    return out


NODE = ("part int, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
        "ends_sha256 string, key binary, begins boolean, parent_conv_id long, parent_key binary")


def _nodes(edges: dict[int, tuple[int, int]]):
    """Rows of one partition of the sorted sequences -> its nodes, and partial rows of those that cross its edges.
    ``edges``: LCP with the row before the partition and with the row after it, -1 where there is none."""

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [("path", "ascending")])).combine_chunks()
        part = table.column("part")[0].as_py()
        before, after = edges[part]
        paths = table.column("path").to_pylist()
        length = np.array([len(p) // KEY for p in paths], np.int64)
        offset = np.concatenate(([0], np.cumsum(length)))[:-1]
        keys = np.frombuffer(b"".join(paths), np.uint64).reshape(-1, 2)
        chars = table.column("chars").combine_chunks()
        flat = chars.flatten().to_numpy(zero_copy_only=False)
        upto = np.concatenate(([0], np.cumsum(flat, dtype=np.int64)))
        count, conv = (table.column(c).to_numpy() for c in ("n", "conv_id"))
        rows = len(paths)

        lcp = _neighbour_lcps(keys, offset, length)
        lcp[0] = before
        minima, least_conv = RangeMin(lcp), RangeMin(conv)

        def chars_of(row: np.ndarray, depth: np.ndarray) -> np.ndarray:
            return upto[offset[row] + depth] - upto[offset[row]]

        def running(values: np.ndarray) -> np.ndarray:
            return np.concatenate(([0], np.cumsum(values)))

        every = np.arange(rows)
        all_chars = chars_of(every, length)
        members, weight = running(count), running(count * all_chars)
        new_chars = running(all_chars - chars_of(every, np.maximum(lcp, 0)))
        leaf = running(np.append(lcp[1:], after) < length)
        places = np.sort((lcp + 1) * rows + every)  # rows by LCP, then by place

        # candidates: the prefixes that begin at a row, and those that came from the partition before
        first = np.maximum(lcp, -1) + 1
        first[0] = 0
        n_each = length - first + 1
        row = np.repeat(every, n_each)
        depth = np.arange(len(row)) - np.repeat(np.cumsum(n_each) - n_each, n_each) + np.repeat(first, n_each)

        def extent(row: np.ndarray, depth: np.ndarray):
            lo, hi = minima.left(row, depth), minima.right(row, depth)
            return lo, hi, (lo == 0) & (before >= depth), (hi == rows - 1) & (after >= depth)

        lo, hi, from_left, to_right = extent(row, depth)
        begins = ~from_left
        n = members[hi + 1] - members[lo]
        inside = lo + begins  # rows after the one the node begins at
        children = (np.searchsorted(places, (depth + 1) * rows + hi, "right")
                    - np.searchsorted(places, (depth + 1) * rows + inside, "left")) + (begins & (length[lo] > depth))
        above = chars_of(lo, np.maximum(depth - 1, 0))
        once = new_chars[hi + 1] - new_chars[inside] + np.where(begins, all_chars[lo] - above, 0)
        saved = weight[hi + 1] - weight[lo] - n * above - once

        up = np.maximum(depth - 1, 0)
        p_lo, p_hi, p_left, p_right = extent(lo, up)
        has_parent, p_open = depth > 0, p_left | p_right
        p_conv = least_conv.least(p_lo, p_hi)
        head, tail = _prefix_keys(paths[0]), _prefix_keys(paths[-1])

        def name(open_left: np.ndarray, open_right: np.ndarray, depth: np.ndarray, wanted: np.ndarray) -> pa.Array:
            return pa.array([None if not w else head[d] if a else tail[d] if b else None for a, b, d, w in zip(
                open_left.tolist(), open_right.tolist(), depth.tolist(), wanted.tolist(), strict=True)], pa.binary())

        ends = table.column("ends").to_pylist()
        return pa.table({
            "part": pa.array(np.full(len(row), part), pa.int32()), "depth": depth,
            "conv_id": least_conv.least(lo, hi), "n_convs": n, "n_children": children.astype(np.int64),
            "n_leaves": (leaf[hi + 1] - leaf[lo]).astype(np.int64), "saved_tokens": saved,
            "ends_sha256": pa.array([ends[i] if b and d == k else None for i, b, d, k in zip(
                lo.tolist(), begins.tolist(), depth.tolist(), length[lo].tolist(), strict=True)], pa.string()),
            "key": name(from_left, to_right, depth, np.ones(len(row), bool)), "begins": pa.array(begins),
            "parent_conv_id": pa.array(p_conv, pa.int64(), mask=~has_parent | p_open),
            "parent_key": name(p_left, p_right, up, has_parent)})

    return run


def _sorted_parts(seqs: DataFrame) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """The distinct sequences in order, with the number of their partition, and the LCPs over its edges."""
    table = save(seqs.repartitionByRange(partitions(seqs.sparkSession), "path").sortWithinPartitions("path").withColumn(
        "part", F.spark_partition_id()), "sequences")
    # a row per partition meets here, and a number per partition at the driver
    ends = table.groupBy("part").agg(F.min("path").alias("first"), F.max("path").alias("last")).withColumn(
        "previous", F.lag("last").over(Window.orderBy("part")))

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [-1 if p is None else shared_turns(p, f) for p, f in zip(
                b.column("previous").to_pylist(), b.column("first").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("part"), pa.array(found, pa.int64())], names=["part", "lcp"])

    lcps = {r.part: r.lcp for r in ends.mapInArrow(shared, "part int, lcp long").collect()}
    order = sorted(lcps)
    return table, {p: (lcps[p], lcps[order[i + 1]] if i + 1 < len(order) else -1) for i, p in enumerate(order)}


def prefix_trie(lists: DataFrame) -> DataFrame:
    """One row per node of the trie over ``lists`` (conv_id, turns of ``turn_lists``): conv_id (smallest member),
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    The root has depth 0 and stands for all conversations, those without a
    turn included.  Equal sequences end at one node; a conversation id that
    is there twice counts twice.  Null turns count as none; rows without an
    id are left out.  An empty table gives no rows, not even a root.
    """
    spark = lists.sparkSession
    ship_package(spark)
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["key"]), ""))
    members = save(lists.where("conv_id IS NOT NULL").select(
        "conv_id", F.coalesce(path, F.lit(b"")).alias("path"),
        F.coalesce(F.transform("turns", lambda t: t["chars"]), F.array().cast("array<long>")).alias("chars")).withColumn(
            "seq", F.unhex(F.substring(F.sha2("path", 256), 1, 2 * KEY))), "members")
    seqs = members.groupBy("seq", "path").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"),
                                              F.first("chars").alias("chars"))
    table, edges = _sorted_parts(seqs.join(_ends(members), "seq").select("path", "chars", "n", "conv_id", "ends"))
    nodes = save(table.groupBy("part").applyInArrow(_nodes(edges), NODE), "nodes")

    across = nodes.where("key IS NOT NULL")
    begun = F.when(F.col("begins"), F.col("part"))
    merged = save(across.groupBy("key").agg(
        F.max(begun).alias("part"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.max("ends_sha256").alias("ends_sha256"),
        F.max(F.when(F.col("begins"), F.col("parent_key"))).alias("parent_key")), "crossing")
    # a partition's own copy of the crossing nodes, so that children of a common node do not meet in one task
    parents = across.select("part", "key").join(merged.select("key", F.col("conv_id").alias("found")), "key").select(
        "part", F.col("key").alias("parent_key"), "found")
    columns = ["part", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
               "parent_conv_id", "parent_key"]
    rows = nodes.where("key IS NULL").select(columns).unionByName(
        merged.withColumn("parent_conv_id", F.lit(None).cast("long")).select(columns))
    known = rows.where("parent_key IS NULL").drop("part", "parent_key")
    looked = rows.where("parent_key IS NOT NULL").join(parents, ["part", "parent_key"], "left").withColumn(
        "parent_conv_id", F.col("found")).drop("part", "parent_key", "found")
    return known.unionByName(looked).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))

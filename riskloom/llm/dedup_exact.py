"""Exact dedup by an extendible-hash index on shared files.

The 64-bit hash of a text is its key.  The directory maps the first ``depth``
bits of a key to a bucket; it starts with one bucket and doubles whenever an
overfull bucket is as deep as the directory, until every bucket holds at most
its share (or the directory its bound of ``2**MAX_DEPTH`` slots: a bucket that
is still overfull then is streamed, not held).  Owner tasks take contiguous
key ranges in key order, chain the texts of one key, compare their bytes and
write the entries ``(bucket, key, link, ...)``: the index.

Only what can collide moves with its text: a fixed bitmap (``2**FILTER_BITS``
bits) of the keys that occur twice or more tells the scan which texts the
owners need; all other entries carry the digest alone.  A task sends equal
texts once with their count, so a text that holds a third of all rows reaches
its owner as one entry per scan task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import arrow_batch, partitions, save, text_of

MAX_DEPTH = 16
FILTER_BITS = 24
#: Bytes of an entry without its text, and of texts that a scan task holds before it sends them.
ENTRY_BYTES, HELD_BYTES = 64, 32 << 20


class Directory:
    """Slots of an extendible-hash directory over the weights of the key prefixes."""

    def __init__(self, weights: np.ndarray, capacity: float):
        self.max_depth = int(len(weights)).bit_length() - 1
        self.sums = np.concatenate([[0], np.cumsum(weights)])
        self.depth, self.slots, self.local, self.prefix = 0, [0], [0], [0]
        self.doublings, todo = 0, [0]
        while todo:
            b = todo.pop()
            if self.weight(b) > capacity and self.local[b] < self.max_depth:
                todo += [b, self._split(b)]

    def weight(self, b: int) -> float:
        wide = self.max_depth - self.local[b]
        return self.sums[(self.prefix[b] + 1) << wide] - self.sums[self.prefix[b] << wide]

    def _split(self, b: int) -> int:
        if self.local[b] == self.depth:  # double: each slot becomes two
            self.slots = [s for s in self.slots for _ in (0, 1)]
            self.depth += 1
            self.doublings += 1
        new = len(self.local)
        self.local[b] += 1
        self.local.append(self.local[b])
        self.prefix[b] <<= 1
        self.prefix.append(self.prefix[b] + 1)
        wide = self.depth - self.local[new]
        for s in range(self.prefix[new] << wide, (self.prefix[new] + 1) << wide):
            self.slots[s] = new
        return new

    def owners(self, tasks: int) -> np.ndarray:
        """Owner task of each slot: contiguous key ranges of about equal weight."""
        share = max(1.0, float(self.sums[-1])) / max(1, tasks)
        out, before = np.zeros(len(self.slots), np.int32), {}
        total = 0.0
        for s, b in enumerate(self.slots):
            if b not in before:
                before[b] = min(tasks - 1, int(total / share))
                total += self.weight(b)
            out[s] = before[b]
        return out


@dataclass
class HashIndex:
    """``members``: (doc_id, key, sha, copies) per distinct row; ``entries``: the index."""

    members: DataFrame
    entries: DataFrame
    directory: Directory


ENTRY = pa.schema([("owner", pa.int32()), ("bucket", pa.int32()), ("key", pa.int64()), ("sha", pa.string()),
                   ("top_id", pa.int64()), ("n", pa.int64()), ("text", pa.string())])
LINK = pa.schema([("bucket", pa.int32()), ("key", pa.int64()), ("link", pa.int32()), ("text_sha256", pa.string()),
                  ("keep_id", pa.int64()), ("group_size", pa.int64())])


def _larger(a, b):
    return b if a is None else a if b is None else max(a, b)


def _send(bitmap: bytes, slots: np.ndarray, owners: np.ndarray, depth: int):
    """Scan side: (doc_id, key, sha, text) -> entries; equal texts of a task once."""
    bits = np.frombuffer(bitmap, np.uint8)

    def place(keys: np.ndarray):
        at = (keys.view(np.uint64) >> np.uint64(64 - depth)).astype(np.int64) if depth else np.zeros(len(keys), np.int64)
        return owners[at], slots[at]

    def flush(held: dict):
        keys = np.array([k for k, _ in held], np.int64)
        own, buckets = place(keys)
        return arrow_batch(ENTRY, [own, buckets, keys, [s for s, _, _ in held.values()],
                                   [i for _, i, _ in held.values()], [n for _, _, n in held.values()],
                                   [t for _, t in held]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for batch in batches:
            keys = batch.column("key").to_numpy()
            at = keys & ((1 << FILTER_BITS) - 1)
            dup = (bits[at >> 3] >> (at & 7)) & 1 == 1
            alone = np.flatnonzero(~dup)
            if len(alone):
                b = batch.take(pa.array(alone))
                own, buckets = place(keys[alone])
                yield arrow_batch(ENTRY, [own, buckets, keys[alone], b.column("sha"), b.column("doc_id"),
                                          np.ones(len(alone), np.int64), pa.nulls(len(alone), pa.string())])
            b = batch.take(pa.array(np.flatnonzero(dup)))
            for key, sha, doc, text in zip(*(b.column(c).to_pylist() for c in ("key", "sha", "doc_id", "text")),
                                           strict=True):
                was = held.get((key, text))
                if was:
                    held[key, text] = (sha, _larger(was[1], doc), was[2] + 1)
                else:
                    held[key, text] = (sha, doc, 1)
                    size += 2 * len(text) + ENTRY_BYTES
            if size > HELD_BYTES:
                yield flush(held)
                held, size = {}, 0
        if held:
            yield flush(held)

    return run


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Owner side: entries in key order; the texts of one key form a chain, told apart by their bytes."""
    key, bucket, chain, out = None, None, [], []

    def close():
        for link, (text, sha, top, n) in enumerate(chain):
            digest = sha if text is None else hashlib.sha256(text.encode()).hexdigest()
            out.append((bucket, key, link, digest, top, n))

    for batch in batches:
        for b, k, sha, top, n, text in zip(*(batch.column(c).to_pylist()
                                             for c in ("bucket", "key", "sha", "top_id", "n", "text")), strict=True):
            if k != key:
                close()
                key, bucket, chain = k, b, []
            for link in chain:
                if link[0] == text and (text is not None or link[1] == sha):
                    link[2], link[3] = _larger(link[2], top), link[3] + n
                    break
            else:
                chain.append([text, sha, top, n])
        if len(out) > 10_000:
            yield arrow_batch(LINK, list(zip(*out, strict=True)))
            out = []
    close()
    if out:
        yield arrow_batch(LINK, list(zip(*out, strict=True)))


def build_index(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                bucket_bytes: int = 4 << 20) -> HashIndex:
    """Index every row of ``docs``; buckets above ``bucket_bytes`` split."""
    spark = docs.sparkSession
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), text_of(docs, text).alias("text")).select(
        "doc_id", F.xxhash64("text").alias("key"), F.sha2(F.col("text"), 256).alias("sha"), "text")
    members = save(rows.select("doc_id", "key", "sha", F.octet_length("text").cast("long").alias("n_bytes"))
                   .groupBy("doc_id", "key", "sha", "n_bytes").agg(F.count(F.lit(1)).alias("copies")), "members")
    keys = save(members.groupBy("key").agg(F.sum("copies").alias("n"), F.max("n_bytes").alias("bytes")), "keys")

    slot = F.col("key").bitwiseAND((1 << FILTER_BITS) - 1)
    bitmap = bytearray(1 << (FILTER_BITS - 3))  # 2 MB at the driver and in each task
    for at, bits in keys.where("n > 1").select(F.shiftright(slot, 15).alias("at"),
                                               slot.bitwiseAND(32767).alias("pos")).groupBy("at").agg(
            F.bitmap_construct_agg("pos")).collect():  # at most 512 rows
        bitmap[at << 12:(at + 1) << 12] = bits
    weight = F.lit(ENTRY_BYTES) + F.when(F.col("n") > 1, F.col("bytes")).otherwise(0)
    weights = np.zeros(1 << MAX_DEPTH)  # at most 65,536 sums at the driver
    for at, w in keys.groupBy(F.shiftrightunsigned("key", 64 - MAX_DEPTH).alias("at")).agg(
            F.sum(weight.cast("double"))).collect():
        weights[at] = w
    tasks = partitions(spark)
    directory = Directory(weights, max(1.0, min(float(bucket_bytes), weights.sum() / (4 * tasks))))
    send = _send(bytes(bitmap), np.array(directory.slots, np.int32), directory.owners(tasks), directory.depth)
    entries = (rows.mapInArrow(send, "owner int, bucket int, key long, sha string, top_id long, n long, text string")
               .repartitionById(tasks, F.col("owner")).sortWithinPartitions("key")
               .mapInArrow(_own, "bucket int, key long, link int, text_sha256 string, keep_id long, group_size long"))
    return HashIndex(members, save(entries, "hash-index"), directory)


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as empty.  The row with
    the largest doc_id of equal texts is kept (null ids are the smallest); of
    repeated rows with that doc_id exactly one is.  An empty table gives no
    rows; other columns are ignored.
    """
    index = build_index(docs, text, doc_id)
    groups = index.entries.where("group_size > 1").select("key", F.col("text_sha256").alias("sha"), "keep_id",
                                                          "group_size")
    rows = index.members.join(groups, ["key", "sha"], "left")
    grouped = F.col("group_size").isNotNull()
    rows = rows.select("doc_id", F.when(grouped, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
                       F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), "sha",
                       F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return rows.select("doc_id", "keep_id", "group_size",
                       (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
                       F.col("sha").alias("text_sha256"))


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, all columns; one of each group of equal texts."""
    groups = save(exact_groups(docs, text, doc_id).select("doc_id", "kept", "text_sha256"), "exact")
    lost = groups.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    gone = lost.where("not kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    stay = docs.join(gone, docs[doc_id].cast("long").eqNullSafe(gone["__id"])
                     & (F.sha2(text_of(docs, text), 256) == gone["__sha"]), "left_anti")
    if lost.where("kept and n > 1").isEmpty():
        return stay
    # the same row repeated: its id and text are equal, so one of them is any of them
    sha = max((c for c in docs.columns), key=len) + "_sha"  # no column's name
    return stay.withColumn(sha, F.sha2(text_of(stay, text), 256)).dropDuplicates([doc_id, sha]).drop(sha)

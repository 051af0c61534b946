"""Token ids in wavelet-matrix files.

Documents are written in ascending doc_id order, one Parquet file per shard
(a range of doc_ids).  A row of a file is a segment of whole documents with
about ``SEGMENT`` tokens: its ids as a wavelet matrix (one bit-plane per id
bit, each with sampled ranks and its number of zeros) and the documents'
ids and lengths.  ``WaveletMatrix`` answers access, rank, counts and
select from the planes; ``token_occurrences`` and ``token_counts_in`` look a
token up in the files, and ``read_documents`` reads all ids back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import partitions, ship_package, text_of
from .tokens import encoder, vocabulary

SEGMENT = 1 << 21
#: One sampled rank for so many bits.
SAMPLE = 4096


class WaveletMatrix:
    """Succinct sequence: plane ``l`` holds bit ``width - 1 - l`` of the ids, in the order of the planes above it."""

    def __init__(self, n: int, planes: list[bytes], zeros: list[int], ranks: list[bytes]):
        self.n, self.width = n, len(planes)
        self.bits = [np.frombuffer(p, np.uint8) for p in planes]
        self.zeros = zeros
        self.ranks = [np.frombuffer(r, "<u4") for r in ranks]

    @classmethod
    def build(cls, ids: np.ndarray, width: int) -> WaveletMatrix:
        planes, zeros, ranks, seq = [], [], [], ids
        for level in range(width):
            bit = (seq & seq.dtype.type(1 << (width - 1 - level))) != 0
            packed = np.packbits(bit, bitorder="little")
            sums = np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), SAMPLE // 8), dtype=np.uint32) \
                if len(packed) else np.zeros(0, np.uint32)
            planes.append(packed.tobytes())
            ranks.append(np.concatenate([[0], np.cumsum(sums)]).astype("<u4").tobytes())
            seq = np.concatenate([np.compress(~bit, seq), np.compress(bit, seq)])
            zeros.append(int(len(ids) - np.count_nonzero(bit)))
        return cls(len(ids), planes, zeros, ranks)

    def ones(self, level: int, end: int) -> int:
        """Set bits of a plane before ``end``: a sampled rank and a count of the rest of its block."""
        block = end // SAMPLE
        at = block * SAMPLE // 8
        whole, left = divmod(end - block * SAMPLE, 8)
        bits = self.bits[level]
        n = int(self.ranks[level][block]) + int(np.bitwise_count(bits[at:at + whole]).sum())
        return n + (int(bits[at + whole]) & ((1 << left) - 1)).bit_count() if left else n

    def bit(self, level: int, i: int) -> int:
        return int(self.bits[level][i >> 3]) >> (i & 7) & 1

    def access(self, i: int) -> int:
        """The id at position ``i``."""
        value = 0
        for level in range(self.width):
            one, before = self.bit(level, i), self.ones(level, i)
            value = value << 1 | one
            i = self.zeros[level] + before if one else i - before
        return value

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        """Where ``token`` of positions ``start`` to ``end`` lies below the last plane."""
        for level in range(self.width):
            a, b = self.ones(level, start), self.ones(level, end)
            if token >> (self.width - 1 - level) & 1:
                start, end = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, end = start - a, end - b
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of ``token`` in positions ``start`` to ``end``: rank by rank of the planes."""
        if token >> self.width:
            return 0
        a, b = self._range(token, start, self.n if end is None else end)
        return b - a

    def _select_bit(self, level: int, one: int, k: int) -> int:
        """Position of the ``k``-th (from 0) set or clear bit of a plane."""
        ranks = self.ranks[level].astype(np.int64)
        if not one:
            ranks = np.minimum(np.arange(len(ranks)) * SAMPLE, self.n) - ranks
        block = int(np.searchsorted(ranks, k, side="right")) - 1
        bits = np.unpackbits(self.bits[level][block * SAMPLE // 8:(block + 1) * SAMPLE // 8], bitorder="little")
        bits = bits[:self.n - block * SAMPLE]
        return block * SAMPLE + int(np.flatnonzero(bits == one)[k - int(ranks[block])])

    def select(self, token: int, k: int) -> int:
        """Position of the ``k``-th occurrence (from 0) of ``token``; -1 if there are fewer."""
        if token >> self.width:
            return -1
        start, end = self._range(token, 0, self.n)
        if k >= end - start:
            return -1
        i = start + k
        for level in reversed(range(self.width)):
            one = token >> (self.width - 1 - level) & 1
            i = self._select_bit(level, one, i - self.zeros[level] if one else i)
        return i

    def decode(self) -> np.ndarray:
        """All ids, from the last plane up."""
        kind = np.uint16 if self.width <= 16 else np.uint32
        seq = np.zeros(self.n, kind)
        for level in reversed(range(self.width)):
            bit = np.unpackbits(self.bits[level], count=self.n, bitorder="little").view(bool)
            up, z = np.empty(self.n, kind), self.zeros[level]
            up[~bit] = seq[:z]
            up[bit] = seq[z:] | kind(1 << (self.width - 1 - level))
            seq = up
        return seq


FILE = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("n_tokens", pa.int64()),
                  ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
                  ("planes", pa.list_(pa.binary())), ("zeros", pa.list_(pa.int64())), ("ranks", pa.list_(pa.binary()))])
FILE_DDL = ("shard int, segment int, n_tokens long, doc_ids array<long>, lengths array<long>, planes array<binary>, "
            "zeros array<long>, ranks array<binary>")


def write_wavelet(docs: DataFrame, path: str, vocab: str | None = None, end_id: int = 0, text: str = "text",
                  doc_id: str = "doc_id") -> None:
    """Encode every row of ``docs`` by the tokenizers library, append ``end_id`` to each, and write the files.

    Order is ascending doc_id, null ids first, ties by text.  Null text counts as empty and still has its end id.
    """
    vocab = vocab or vocabulary("byte_bpe_50k.json")
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(vocab), int(end_id).to_bytes(4, "little")
        width = max(1, int(enc.library.get_vocab_size() - 1).bit_length())
        kind = np.uint16 if width <= 16 else np.uint32
        shard, segment, docs_, lengths, held, size = TaskContext.get().partitionId(), 0, [], [], [], 0

        def row() -> pa.RecordBatch:
            w = WaveletMatrix.build(np.concatenate(held), width)
            return pa.RecordBatch.from_pylist([{
                "shard": shard, "segment": segment, "n_tokens": w.n, "doc_ids": docs_, "lengths": lengths,
                "planes": [b.tobytes() for b in w.bits], "zeros": w.zeros, "ranks": [r.tobytes() for r in w.ranks]}],
                schema=FILE)

        for b in batches:
            for doc, own in zip(b.column("doc_id"), enc.ids_of(b.column("text").to_pylist()), strict=True):
                ids = np.frombuffer(own + end, "<u4").astype(kind)
                docs_.append(doc.as_py())
                lengths.append(len(ids))
                held.append(ids)
                size += len(ids)
                if size >= SEGMENT:
                    yield row()
                    segment, docs_, lengths, held, size = segment + 1, [], [], [], 0
        if docs_:
            yield row()

    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), text_of(docs, text).alias("text"))
    (rows.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
     .mapInArrow(run, FILE_DDL).write.option("compression", "zstd").parquet(path))


def _files(spark: SparkSession, path: str) -> DataFrame:
    ship_package(spark)
    return spark.read.schema(FILE_DDL).parquet(path)


def _matrix(row: dict) -> WaveletMatrix:
    return WaveletMatrix(row["n_tokens"], row["planes"], row["zeros"], row["ranks"])


def _based(files: DataFrame) -> DataFrame:
    """(shard, segment, base): ids before each segment.  One row per segment, and one per shard, is all that meets."""
    sizes = files.select("shard", "segment", "n_tokens")
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    upto = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("shard_base"))
    inside = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(shards, "shard").select(
        "shard", "segment", (F.col("shard_base") + F.col("inside")).alias("base"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Every document from the files: doc_id, shard, segment, at (ids before it in its segment), n_tokens, ids (binary,
    little-endian uint32).  ``with_starts`` turns places into starts; what derives from the ids comes first, so that
    ids need not move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids = _matrix(row).decode().astype("<u4").tobytes()
                ends = np.cumsum(row["lengths"])
                starts = ends - np.array(row["lengths"])
                for at in range(0, len(ends), 4096):
                    part = slice(at, at + 4096)
                    n = len(ends[part])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["shard"]] * n, pa.int32()), pa.array([row["segment"]] * n, pa.int32()),
                         pa.array(row["doc_ids"][part], pa.int64()), pa.array(starts[part], pa.int64()),
                         pa.array(row["lengths"][part], pa.int64()),
                         pa.array([ids[4 * s:4 * e] for s, e in zip(starts[part].tolist(), ends[part].tolist())],
                                  pa.binary())],
                        names=["shard", "segment", "doc_id", "at", "n_tokens", "ids"])

    return _files(spark, path).mapInArrow(
        run, "shard int, segment int, doc_id long, at long, n_tokens long, ids binary")


def with_starts(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """``rows`` of ``read_documents`` with ``start`` (ids of all documents before) in place of shard, segment and at."""
    based = rows.join(_based(_files(spark, path)), ["shard", "segment"])
    return based.withColumn("start", F.col("base") + F.col("at")).drop("shard", "segment", "at", "base")


def token_counts_in(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(shard, segment, n): how often ``token`` occurs, by rank on the planes, without decoding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column("shard"), b.column("segment"),
                 pa.array([_matrix(r).count(token) for r in b.to_pylist()], pa.int64())], names=["shard", "segment", "n"])

    return _files(spark, path).mapInArrow(run, "shard int, segment int, n long")


def token_occurrences(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(doc_id, position in the document) of each occurrence of ``token``, by select on the planes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                w = _matrix(r)
                at = np.array([w.select(token, k) for k in range(w.count(token))], np.int64)
                ends = np.cumsum(r["lengths"])
                doc = np.searchsorted(ends, at, side="right")
                begin = (ends - np.array(r["lengths"]))[doc] if len(at) else at
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["doc_ids"][i] for i in doc.tolist()], pa.int64()), pa.array(at - begin, pa.int64())],
                    names=["doc_id", "position"])

    return _files(spark, path).mapInArrow(run, "doc_id long, position long")

"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Targets come from the sources' weights and sizes.  A source's documents are
cut into blocks by a seeded hash; whole epochs take every block, and the last
epoch goes through all blocks in permuted order and takes what still fits,
whole blocks or, of a block that does not fit, its documents in key order,
until no unused document with words fits.  The blocks drawn from are the
source's quota.  The
tree splits the vector of quotas between the halves of the output shards, a
multivariate-hypergeometric draw at each node, down to single shards: every
shard has an exact quota of each source, distributed as if all blocks had
been shuffled together.  Shards then take disjoint ranges of each source's
permuted blocks and shuffle their documents locally.

Only tables with a row per block (at most ``BLOCKS`` a source) meet at the
driver, and sources are a dimension table; documents never do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import WORD, partitions, save, text_of

#: Blocks of a source at most, and documents of a block at least.
BLOCKS, BLOCK_DOCS = 256, 64


def targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Water-filling: ``share`` of all sizes by weight; no target above ``most`` times its size."""
    left, open_, out = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        whole = sum(weights[i] for i in open_)
        if whole <= 0:
            break
        for i in open_:
            out[i] = left * weights[i] / whole
        over = [i for i in open_ if out[i] > most * sizes[i]]
        if not over:
            break
        for i in over:
            out[i] = float(most * sizes[i])
            left -= out[i]
            open_.discard(i)
    return out


def split_quotas(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shards, sources) block quotas by recursive multivariate-hypergeometric splits; columns add up to ``quotas``."""
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    take = int(quotas.sum()) * left // shards
    drawn, rest = np.zeros_like(quotas), int(quotas.sum())
    for s, q in enumerate(quotas.tolist()):  # one source after another, given what is left to take
        rest -= q
        drawn[s] = rng.hypergeometric(q, rest, take) if q and take else 0
        take -= int(drawn[s])
    return np.concatenate([split_quotas(drawn, left, rng), split_quotas(quotas - drawn, shards - left, rng)])


def _shuffled(n: int, seed: int, source: int, epoch: int) -> np.ndarray:
    return np.random.default_rng([seed, source, epoch]).permutation(n)


def _checked(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a driver-made table of a known, small number of rows."""
    return F.broadcast(df) if rows <= 50_000 else df


@dataclass
class MixPlan:
    """Tables of the plan: a row per source, a row per block, and the documents taken of blocks that do not fit."""

    rows: DataFrame     # doc_id, source, key, size of every document
    sources: DataFrame  # source_no, source, source_size, target, blocks
    blocks: DataFrame   # source_no, block, full (shards of whole draws), edge (shard of the draw in part)
    fits: DataFrame     # key, doc_id, fitting (how many of the repeated rows)
    n_sources: int
    n_blocks: int

    def assign(self, rows: DataFrame) -> DataFrame:
        """``rows`` with (__id, __source, __key) plus source_size, target and shards: one output shard per copy taken."""
        at = rows.join(_checked(self.sources, self.n_sources), F.col("__source").eqNullSafe(F.col("source_name")))
        at = at.withColumn("block", _block()).join(_checked(self.blocks, self.n_blocks), ["source_no", "block"], "left")
        full = F.coalesce("full", F.array().cast("array<int>"))
        # repeated rows share key and id: as many of them are taken as fit
        nth = F.row_number().over(Window.partitionBy("__key", "__id").orderBy("source_no"))
        edge = at.where("edge is not null").join(
            self.fits, (F.col("__key") == F.col("fit_key")) & F.col("__id").eqNullSafe(F.col("fit_id")), "left")
        edge = edge.withColumn("shards", F.when(nth <= F.col("fitting"), F.concat(full, F.array("edge"))).otherwise(full))
        rest = at.where("edge is null").withColumn("shards", full)
        inner = ["source_no", "source_name", "block", "blocks", "full", "edge", "fit_key", "fit_id", "fitting"]
        return edge.drop(*inner).unionByName(rest.drop(*inner))


def _block():
    return F.pmod(F.xxhash64("__key", F.lit("block")), F.col("blocks")).cast("int")


def _keyed(docs: DataFrame, seed: int, text: str, doc_id: str, source: str, *more: Column) -> DataFrame:
    doc = docs[doc_id].cast("long")
    return docs.select(doc.alias("__id"), docs[source].cast("string").alias("__source"),
                       F.xxhash64(doc, text_of(docs, text), F.lit(seed)).alias("__key"), *more)


def mix_plan(docs: DataFrame, weights: tuple = (5.0, 2.0, 1.0), share: float = 1.5, most: int = 2,
             shards: int | None = None, seed: int = 42, text: str = "text", doc_id: str = "doc_id",
             source: str = "source") -> MixPlan | None:
    """Plan the mix of ``docs``; None for an empty table.

    Sources are ordered by code point, null last, and take ``weights`` in turn, repeating.  A null text counts as
    empty; documents without words weigh nothing.  Repeated rows are separate documents.  Reruns agree.
    """
    spark = docs.sparkSession
    shards = shards or partitions(spark)
    rows = save(_keyed(docs, seed, text, doc_id, source, F.regexp_count(
        text_of(docs, text), F.lit(WORD)).cast("long").alias("size")), "sizes")
    found = rows.groupBy("__source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    if not found:
        return None
    found.sort(key=lambda r: (r["__source"] is None, r["__source"] or ""))
    sizes = [r["size"] for r in found]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], share, most)
    blocks = [max(1, min(BLOCKS, r["n"] // BLOCK_DOCS)) for r in found]
    dim = spark.createDataFrame(
        [(i, r["__source"], sizes[i], goal[i], blocks[i]) for i, r in enumerate(found)],
        "source_no int, source_name string, source_size long, target double, blocks int")
    placed = rows.join(_checked(dim, len(found)), F.col("__source").eqNullSafe(F.col("source_name"))).withColumn(
        "block", _block())
    words = [np.zeros(b, np.int64) for b in blocks]
    least = [np.zeros(b, np.int64) for b in blocks]  # the smallest document with words
    for r in placed.groupBy("source_no", "block").agg(
            F.sum("size").alias("w"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least")).collect():
        words[r["source_no"]][r["block"]] = r["w"]  # BLOCKS a source at most
        least[r["source_no"]][r["block"]] = r["least"] or 0

    # draws of blocks: whole epochs, then permuted blocks that fit
    taken, left, later = [], {}, {}
    for i, size in enumerate(sizes):
        epochs = min(most, int(goal[i] // size)) if size else 0
        taken.append([(int(b), False) for e in range(epochs) for b in _shuffled(blocks[i], seed, i, e)])
        if size and goal[i] > epochs * size:
            left[i] = float(goal[i] - epochs * size)
            later[i] = _shuffled(blocks[i], seed, i, most).tolist()[::-1]

    def fit_edge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: dict[int, float] = {}
        for b in batches:
            ok = []
            for i, size, room in zip(b.column("source_no").to_pylist(), b.column("size").to_pylist(),
                                     b.column("room").to_pylist(), strict=True):
                ok.append(size <= left.setdefault(i, room))
                left[i] -= size if ok[-1] else 0
            yield pa.RecordBatch.from_arrays(
                [*map(b.column, ("source_no", "block", "size", "__key", "__id")), pa.array(ok, pa.bool_())],
                names=["source_no", "block", "size", "fit_key", "fit_id", "fits"])

    # blocks that do not fit: their documents that do, one block of a source first, then twice as many each time
    fits, group = [], 1
    while True:
        edge = []
        for i in later:
            chosen = 0
            while later[i] and chosen < group:
                b = later[i][-1]
                if words[i][b] <= left[i] and not chosen:
                    taken[i].append((b, False))
                    left[i] -= int(words[i][b])
                elif least[i][b] <= left[i]:
                    edge.append((i, b, chosen, left[i]))
                    chosen += 1
                later[i].pop()
        if not edge:
            break
        at = spark.createDataFrame(edge, "source_no int, block int, place int, room double")
        near = placed.join(_checked(at, len(edge)), ["source_no", "block"]).where("size <= room").select(
            "source_no", "block", "place", "room", "size", "__key", "__id")
        part = save(near.repartition("source_no").sortWithinPartitions("source_no", "place", "__key", "__id").mapInArrow(
            fit_edge, "source_no int, block int, size long, fit_key long, fit_id long, fits boolean").where("fits"), "part")
        for r in sorted(part.groupBy("source_no", "block").agg(F.sum("size").alias("w")).collect()):
            taken[r["source_no"]].append((r["block"], True))
            left[r["source_no"]] -= r["w"]
        fits.append(part.select("fit_key", "fit_id"))
        group *= 2
    dealt = split_quotas(np.array([len(d) for d in taken], np.int64), shards, np.random.default_rng(seed))
    drawn: dict[tuple[int, int], tuple[list, list]] = {}
    for i, draws in enumerate(taken):  # shards take disjoint ranges of a source's permuted draws
        place = np.repeat(np.arange(shards), dealt[:, i]).tolist()
        for shard, j in zip(place, np.random.default_rng([seed, i]).permutation(len(draws)).tolist(), strict=True):
            block, part = draws[j]
            drawn.setdefault((i, block), ([], []))[part].append(shard)
    table = spark.createDataFrame([(i, b, full, part[0] if part else None) for (i, b), (full, part) in drawn.items()],
                                  "source_no int, block int, full array<int>, edge int")

    none = spark.createDataFrame([], "fit_key long, fit_id long")
    fitting = reduce(DataFrame.unionByName, fits, none).groupBy("fit_key", "fit_id").agg(
        F.count(F.lit(1)).alias("fitting"))
    return MixPlan(rows, dim, table, save(fitting, "edge"), len(found), len(drawn))


def mix_counts(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken (words, repeats counted), copies, source."""
    plan = mix_plan(docs, **options)
    if plan is None:
        return docs.sparkSession.createDataFrame(
            [], "doc_id long, size long, source_size long, target double, taken long, copies long, source string")
    copies = F.size("shards").cast("long")
    return plan.assign(plan.rows).select(
        F.col("__id").alias("doc_id"), "size", "source_size", "target", (copies * F.col("size")).alias("taken"),
        copies.alias("copies"), F.col("__source").alias("source"))


def mix(docs: DataFrame, shards: int | None = None, seed: int = 42, text: str = "text", doc_id: str = "doc_id",
        source: str = "source", **options) -> DataFrame:
    """The mixed rows: all columns of ``docs``, a row per copy taken; a partition per output shard, shuffled inside.

    Columns may have any names: they travel as one struct.  Nulls, empty texts and repeated rows are those of
    ``mix_plan``; documents without words come along with their block, and an empty table comes back as it is.
    """
    shards = shards or partitions(docs.sparkSession)
    plan = mix_plan(docs, shards=shards, seed=seed, text=text, doc_id=doc_id, source=source, **options)
    if plan is None:
        return docs
    row = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")
    rows = plan.assign(_keyed(docs, seed, text, doc_id, source, row)).select(
        "row", "__key", F.posexplode("shards").alias("__no", "__shard"))
    return (rows.repartitionById(shards, F.col("__shard"))
            .sortWithinPartitions(F.xxhash64("__key", "__no", F.lit(seed))).select("row.*"))

"""Product codes of vectors by active-entry Lloyd iteration.

Components become whole numbers, vectors are cut into equal parts, and each
part position has a codebook of at most 256 entries.  A row keeps its assigned
entries and their exact squared distances between rounds.  After an update
only some entries have moved: a part whose assigned entry stayed fixed still
has its stored distance, no other fixed entry can beat it, so it is compared
with the moved entries alone; any other part rescans the whole codebook.

Per round one pass writes the assignments and one pass sums the parts of each
entry in its tasks; the driver holds the codebooks (entries x dimension) only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import save, ship_package

#: Rows that are compared with a codebook at a time.
CHUNK = 2048
#: A limb of sums, so that whole numbers of any size add up in decimals.
LIMB = 60


def _reach(width: int, bits: int) -> int:
    """Largest component for which squared distances of ``width`` components are exact in ``bits`` bits."""
    return isqrt((1 << bits) // (4 * max(1, width))) - 1


def distances(rows: np.ndarray, entries: list[list[int]]) -> np.ndarray:
    """Exact squared distances of whole-number rows (doubles) to entries: doubles or 64-bit integers where they hold
    them, else Python integers."""
    width = rows.shape[1]
    most = max(float(np.abs(rows).max(initial=0)), max((abs(v) for e in entries for v in e), default=0))
    if most <= _reach(width, 53):
        book = np.array(entries, np.float64).reshape(len(entries), width)
        d = (rows * rows).sum(1)[:, None] - 2.0 * (rows @ book.T) + (book * book).sum(1)[None, :]
        return d.astype(np.int64)
    if most <= _reach(width, 63):
        book, whole = np.array(entries, np.int64).reshape(len(entries), width), rows.astype(np.int64)
        return np.stack([((whole - e) ** 2).sum(1) for e in book], 1)
    whole = [[int(v) for v in r] for r in rows.tolist()]
    out = np.empty((len(whole), len(entries)), object)
    for i, r in enumerate(whole):
        out[i] = [sum((a - b) ** 2 for a, b in zip(r, e, strict=True)) for e in entries]
    return out


def assign(rows: np.ndarray, entries: list[list[int]], moved: np.ndarray, code: np.ndarray,
           stored: np.ndarray) -> tuple[np.ndarray, list]:
    """Nearest entry and exact distance of every row; ties go to the lower index.  ``stored`` is the distance to
    entry ``code`` before the entries ``moved``, or -1 where none is known."""
    code, known = code.copy(), np.array(stored, object)
    fixed = (stored >= 0) & ~moved[code]
    active = np.flatnonzero(moved)
    for at in range(0, len(rows), CHUNK):
        part = np.arange(at, min(at + CHUNK, len(rows)))
        again = part[~fixed[part]]
        if len(again):
            d = distances(rows[again], entries)
            code[again] = best = d.argmin(1)
            known[again] = d[np.arange(len(again)), best]
        held = part[fixed[part]]
        if len(held) and len(active):
            d = distances(rows[held], [entries[e] for e in active])
            best = d.argmin(1)
            least = d[np.arange(len(held)), best]
            better = ((least < known[held]) | ((least == known[held]) & (active[best] < code[held]))).astype(bool)
            code[held[better]] = active[best[better]]
            known[held[better]] = least[better]
    return code, [int(v) for v in known]


@dataclass(frozen=True)
class Codes:
    """``rows``: vec_id, label, code (binary, a byte per part; null for a vector of another length), error."""
    rows: DataFrame
    codebooks: list[list[list[int]]]

    def digest(self) -> str:
        """SHA-256 of all entries' components by part, entry and position, comma-joined."""
        return hashlib.sha256(",".join(str(v) for book in self.codebooks for e in book for v in e).encode()).hexdigest()


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _assign(books: list, moved: list | None, dim: int, names: list[str]):
    parts, width = len(books), dim // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, n = _matrix(b.column("whole"), dim), b.num_rows
            if moved is None:
                was, stored = np.zeros((n, parts), np.int64), np.full((n, parts), -1, np.int64)
            else:
                was = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(n, parts).astype(np.int64)
                stored = _matrix(b.column("stored"), parts)
            codes, found = np.empty((n, parts), np.uint8), []
            for p, book in enumerate(books):
                all_moved = np.ones(len(book), bool) if moved is None else np.array(moved[p])
                code, d = assign(rows[:, p * width:(p + 1) * width], book, all_moved, was[:, p], stored[:, p])
                codes[:, p] = code
                found.append(d)
            totals = [sum(d) for d in zip(*found, strict=True)]
            fits = [[v if v < 1 << 63 else -1 for v in d] for d in zip(*found, strict=True)]
            out = {"vec_id": b.column("vec_id"), "label": b.column("label"), "whole": b.column("whole"),
                   "code": pa.array([c.tobytes() for c in codes], pa.binary()),
                   "stored": pa.array(fits, pa.list_(pa.int64())),
                   "error": pa.array([t if t < 1 << 63 else None for t in totals], pa.int64())}
            yield pa.RecordBatch.from_arrays([out[c] for c in names], names=names)

    return run


def _sums(sizes: list[int], dim: int):
    """Sums and counts of the parts of each entry in a task, as (part, entry, position, n, high, low)."""
    parts, width = len(sizes), dim // len(sizes)
    exact = 1 << 53

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = [np.zeros(k, np.int64) for k in sizes]
        total = [np.zeros((k, width), object) for k in sizes]
        for b in batches:
            rows = _matrix(b.column("whole"), dim)
            codes = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(b.num_rows, parts)
            small = float(np.abs(rows).max(initial=0)) * max(1, len(rows)) < exact
            for p, k in enumerate(sizes):
                own = rows[:, p * width:(p + 1) * width]
                count[p] += np.bincount(codes[:, p], minlength=k)
                if small:
                    for j in range(width):
                        total[p][:, j] += np.bincount(codes[:, p], own[:, j], k).astype(np.int64)
                else:
                    for c, r in zip(codes[:, p].tolist(), own.tolist(), strict=True):
                        total[p][c] += [int(v) for v in r]
        out = [(p, e, j, int(count[p][e]), int(total[p][e, j]) >> LIMB, int(total[p][e, j]) & ((1 << LIMB) - 1))
               for p in range(parts) for e in np.flatnonzero(count[p]).tolist() for j in range(width)]
        if out:
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                                             names=["part", "entry", "position", "n", "high", "low"])

    return run


def encode_vectors(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024,
                   vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> Codes:
    """Train the codebooks on all vectors and code every one of them.

    Rows whose vector is null or holds a null, a NaN, an infinity or a number
    of 2**128 and more are left out.  The codebooks start as the parts of the
    ``entries`` smallest vec_ids (null ids last, ties by vector).  The
    dimension is that of the smallest vec_id and must be a multiple of
    ``parts``; vectors of another length stay with a null code and error.  An
    error that 64 bits cannot hold is null.  Repeated rows count as often as
    they stand.  An empty table gives no rows and empty codebooks; other
    columns are ignored.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte a part: 1 to 256 entries")
    numbers = F.transform(vectors[vector], lambda x: x.cast("double"))
    kept = vectors.select(vectors[vec_id].cast("long").alias("vec_id"), vectors[label].alias("label"),
                          numbers.alias("v")).where("v IS NOT NULL").where(F.forall(
                              "v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(2.0 ** 128)), F.lit(False))))
    order = [F.col("vec_id").asc_nulls_last(), "v"]
    first = kept.orderBy(*order).select(F.size("v")).first()
    empty = kept.select("vec_id", "label", F.lit(None).cast("binary").alias("code"),
                        F.lit(None).cast("long").alias("error"))
    if first is None:
        return Codes(empty, [[] for _ in range(parts)])
    dim = first[0]
    if dim % parts:
        raise ValueError(f"{dim} components cannot be cut into {parts} equal parts")
    same = kept.where(F.size("v") == dim)
    width = dim // parts
    start = [np.floor(np.array(r.v) * scale).tolist() for r in same.orderBy(*order).limit(entries).select("v").collect()]
    books = [[[int(v) for v in r[p * width:(p + 1) * width]] for r in start] for p in range(parts)]

    kind = same.schema["label"].dataType.simpleString()
    ddl = f"vec_id long, label {kind}, whole array<double>, code binary, stored array<long>, error long"
    names = ["vec_id", "label", "whole", "code", "stored", "error"]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = np.floor(_matrix(b.column("v"), dim) * scale)
            ends = np.arange(b.num_rows + 1, dtype=np.int32) * dim
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("label"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.ravel()))],
                names=["vec_id", "label", "whole"])

    rows = same.mapInArrow(whole, f"vec_id long, label {kind}, whole array<double>")
    state = save(rows.mapInArrow(_assign(books, None, dim, names), ddl), "codes")
    for _ in range(rounds):
        sums = state.select("whole", "code").mapInArrow(
            _sums([len(b) for b in books], dim), "part int, entry int, position int, n long, high decimal(38,0), low long")
        moved = [[False] * len(b) for b in books]
        for r in sums.groupBy("part", "entry", "position").agg(
                F.sum("n").alias("n"), F.sum("high").alias("high"),
                F.sum(F.col("low").cast("decimal(38,0)")).alias("low")).collect():  # entries x dimension at most
            value = ((int(r.high) << LIMB) + int(r.low)) // r.n
            if value != books[r.part][r.entry][r.position]:
                books[r.part][r.entry][r.position] = value
                moved[r.part][r.entry] = True
        if not any(map(any, moved)):
            break
        state = save(state.mapInArrow(_assign(books, moved, dim, names), ddl), "codes")
    other = empty.where(F.lit(False)) if kept.where(F.size("v") != dim).isEmpty() else kept.where(
        F.size("v") != dim).select(*empty.columns[:2], F.lit(None).cast("binary").alias("code"),
                                   F.lit(None).cast("long").alias("error"))
    return Codes(state.select("vec_id", "label", "code", "error").unionByName(other), books)


def with_label_errors(rows: DataFrame) -> DataFrame:
    """``rows`` of ``Codes`` with ``label_error``: errors summed over equal labels (nulls together, null errors left
    out; null where 64 bits cannot hold the sum).  A label is aggregated in every task before it meets its rows."""
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = rows.groupBy("label").agg(total.try_cast("long").alias("label_error")).withColumnRenamed("label", "of_label")
    return rows.join(sums, rows["label"].eqNullSafe(sums["of_label"]), "left").drop("of_label")

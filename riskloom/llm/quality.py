"""Quality classifier from weak labels.

Heuristic labellers vote junk, clean or nothing on each whole text.  Their
votes are counted per vote pattern over all documents (at most ``3**m``
patterns), and expectation-maximisation estimates, for each labeller and
class, how often it gives each vote, with the share of junk: labellers may
overlap and be right about a part of the junk only.  The posterior of a
document's pattern labels a bounded sample, on which a linear scorer over
hashed word shapes is trained; that scorer judges every document.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import save, ship_package, text_of

BUCKETS = 1 << 12
#: The scorer trains on at most so many documents, those of the lowest hash.
TRAIN_ROWS = 8192
#: A labeller calls at most this share of clean texts junk.
FALSE_ALARM = 0.001
JUNK, CLEAN, NONE = 2, 1, 0

_SHAPE = bytes.maketrans(
    bytes(range(256)),
    bytes(88 if 65 <= b <= 90 else 120 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57
          else 32 if b in b" \t\n\r\x0b\x0c" else b for b in range(256)))
_RUNS = [(re.compile(c + b"{2,}"), c) for c in (b"x", b"X", b"0")]


_MARKS = re.compile(rb"([^A-Za-z0-9.])\1").search


def _stats(text: str) -> tuple[Counter, int, int, int, int]:
    """Counts of the collapsed word shapes; words, different words, words equal to the one before, the commonest's count."""
    shape = text.encode("utf-8", "surrogatepass").translate(_SHAPE)
    for runs, one in _RUNS:
        shape = runs.sub(one, shape)
    words = text.split()
    times = Counter(words)
    return (Counter(shape.split()), len(words), len(times), sum(map(eq, words, words[1:])),
            max(times.values(), default=0))


def _vote(share: float, clean: float, junk: float, enough: bool = True) -> int:
    return NONE if not enough else JUNK if share >= junk else CLEAN if share <= clean else NONE


def _is_upper(shape: bytes) -> bool:
    return shape.startswith(b"X") and b"x" not in shape


def labellers(stats: tuple) -> list[int]:
    """One vote of each heuristic labeller; few words: no vote."""
    shapes, n, distinct, repeats, top = stats
    if n < 5:
        return [NONE] * 7
    share = lambda test: sum(c for s, c in shapes.items() if test(s)) / n
    return [
        _vote(share(lambda s: any(ch in s for ch in b"#$%&*|<>{}=~^")), 0.02, 0.2),   # symbols in words
        _vote(share(_is_upper), 0.05, 0.4, n >= 10),                                   # shouted words
        _vote(repeats / n, 0.05, 0.3, n >= 10),                                        # a word after itself
        _vote(share(_MARKS), 0.02, 0.2),                                               # a mark twice or more
        _vote(share(lambda s: not s[-1:].isalnum()), 0.35, 0.5, n >= 10),              # words that end in a mark
        _vote(top / n, 0.2, 0.5, n >= 20),                                             # one word everywhere
        _vote(1 - distinct / n, 0.5, 0.85, 50 <= n <= 5000),                           # few different words
    ]


LABELLERS = 7


def _pattern(votes: list[int]) -> int:
    return sum(v * 3 ** i for i, v in enumerate(votes))


def _features(stats: tuple) -> dict[int, float]:
    """Hashed features: root shares of word shapes, and bins of the repetition measures."""
    shapes, n, distinct, repeats, top = stats
    if not n:
        return {}
    out: dict[int, float] = {}
    for s, c in shapes.items():
        b = xxhash.xxh64_intdigest(s[:16], 8) % BUCKETS
        out[b] = out.get(b, 0.0) + c / n
    out = {b: v ** 0.5 for b, v in out.items()}
    for name, value in (("repeat", repeats / n), ("top", top / n if n >= 20 else 0.0),
                        ("same", 1 - distinct / n if n >= 50 else 0.0)):
        b = xxhash.xxh64_intdigest(f"{name} {int(value * 10)}", 8) % BUCKETS
        out[b] = out.get(b, 0.0) + 1.0
    return out


@dataclass
class QualityModel:
    """``votes[class, labeller, vote]``: how often a labeller that votes gives each vote (0 for none is 1: a missing
    vote says nothing), the share of junk, and the scorer's weights (last: intercept)."""

    votes: np.ndarray
    junk_share: float
    weights: np.ndarray

    def posterior(self, pattern: int) -> float:
        """P(junk) of a vote pattern."""
        return float(_posterior(np.array([pattern]), self.votes, self.junk_share)[0])

    def judge(self, stats: tuple) -> float:
        """P(junk) by the linear scorer; 0 for a text without words."""
        if not stats[1]:
            return 0.0
        z = self.weights[-1] + sum(self.weights[b] * v for b, v in _features(stats).items())
        return 1 / (1 + math.exp(-min(max(z, -500.0), 500.0)))

    def score(self, text: str | None) -> float:
        return self.judge(_stats(text or ""))


def _posterior(patterns: np.ndarray, votes: np.ndarray, junk: float) -> np.ndarray:
    log = np.log([[1 - junk], [junk]]).repeat(len(patterns), axis=1)
    for i in range(LABELLERS):
        log += np.log(votes[:, i, patterns // 3 ** i % 3])
    log -= log.max(axis=0)
    p = np.exp(log)
    return p[1] / p.sum(axis=0)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200,
                             false_alarm: float = FALSE_ALARM) -> tuple[np.ndarray, float]:
    """Vote frequencies per class and the share of junk, from pattern counts.

    A labeller knows one kind of junk, and kinds exclude each other; a bound on how often it may call clean text junk
    keeps a rare kind, about which all other labellers are wrong, from passing as clean.
    Starts from the rule that any junk vote speaks for junk, which the counts then correct."""
    digits = np.stack([patterns // 3 ** i % 3 for i in range(LABELLERS)])
    p = np.where((digits == JUNK).any(axis=0), 0.999, 0.001)
    votes, junk = np.ones((2, LABELLERS, 3)), 0.1
    for _ in range(rounds):
        weight = np.stack([(1 - p) * counts, p * counts])
        junk = float(np.clip(weight[1].sum() / max(counts.sum(), 1e-9), 1e-6, 1 - 1e-6))
        for v in (CLEAN, JUNK):
            votes[:, :, v] = weight @ (digits == v).T + 0.1
        votes[:, :, 1:] /= votes[:, :, 1:].sum(axis=2, keepdims=True)
        votes[0, :, JUNK] = np.minimum(votes[0, :, JUNK], false_alarm)
        votes[0, :, CLEAN] = 1 - votes[0, :, JUNK]
        new = _posterior(patterns, votes, junk)
        if np.abs(new - p).max(initial=0) < 1e-9:
            break
        p = new
    return votes, junk


def _train(rows: list, labels: np.ndarray, rounds: int = 300, ridge: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels by full-batch steps with momentum."""
    used = sorted({b for r in rows for b in r})
    place = {b: i for i, b in enumerate(used)}
    x = np.zeros((len(rows), len(used) + 1))
    x[:, -1] = 1
    for i, r in enumerate(rows):
        for b, v in r.items():
            x[i, place[b]] = v
    w, step = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = 0.9 * step - 2.0 * (x.T @ (p - labels) / len(rows) + ridge * w)
        w = w + step
    out = np.zeros(BUCKETS + 1)
    out[used] = w[:-1]
    out[-1] = w[-1]
    return out


def fit_quality(docs: DataFrame, train_rows: int = TRAIN_ROWS, text: str = "text") -> QualityModel:
    """Estimate the labellers over all rows of ``docs`` and train the scorer.

    No rows, or no junk votes at all: the scorer keeps everything.
    """
    def votes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_pattern(labellers(_stats(t.as_py()))) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("h"), pa.array(found, pa.int64())], names=["h", "pattern"])

    def features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [list(_features(_stats(t.as_py())).items()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("h"), pa.array(found, pa.map_(pa.int64(), pa.float64()))],
                                             names=["h", "features"])

    body = text_of(docs, text)
    hashed = docs.select(F.xxhash64(body, F.lit(3)).alias("h"), body.alias("text"))
    seen = save(hashed.mapInArrow(votes_of, "h long, pattern long"), "votes")
    counts = seen.groupBy("pattern").count().collect()  # at most 3**7 patterns
    patterns = np.array([r["pattern"] for r in counts], np.int64)
    votes, junk = expectation_maximisation(patterns, np.array([r["count"] for r in counts], float))
    # the sample is drawn before any features are: copies count once
    sample = seen.dropDuplicates(["h"]).orderBy("h").limit(train_rows).collect()  # bounded by train_rows
    digits = [[int(p) // 3 ** i % 3 for i in range(LABELLERS)] for p in patterns]
    if not any(JUNK in d for d in digits) or not sample:
        weights = np.zeros(BUCKETS + 1)
        weights[-1] = -10.0
        return QualityModel(votes, junk, weights)
    labels = _posterior(np.array([r["pattern"] for r in sample], np.int64), votes, junk)
    drawn = F.broadcast(docs.sparkSession.createDataFrame([(r["h"],) for r in sample], "h long"))  # train_rows at most
    texts = hashed.join(drawn, "h", "left_semi").groupBy("h").agg(F.min("text").alias("text"))
    features = {r["h"]: r["features"] for r in texts.mapInArrow(
        features_of, "h long, features map<long,double>").collect()}  # bounded by train_rows
    return QualityModel(votes, junk, _train([features[r["h"]] for r in sample], labels))


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row: doc_id, score (P(junk) by the scorer), weak (P(junk) by
    the labellers' votes), keep (score under one half).  Null text counts as empty;
    empty texts are kept; repeated rows score alike; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        posterior = lru_cache(None)(model.posterior)  # one entry per vote pattern
        for b in batches:
            scores, weak = [], []
            for t in b.column("text"):
                stats = _stats(t.as_py())
                scores.append(model.judge(stats))
                weak.append(posterior(_pattern(labellers(stats))))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(scores), pa.array(weak), pa.array([s < 0.5 for s in scores])],
                names=["doc_id", "score", "weak", "keep"])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), text_of(docs, text).alias("text")).mapInArrow(
        run, "doc_id long, score double, weak double, keep boolean")


def keep_quality(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the scorer keeps, all columns, without a shuffle.  Null text counts as empty, and empty
    texts are kept; repeated rows fare alike."""
    place = [c.lower() for c in docs.columns].index(text.lower())
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(place).to_pylist()
            yield b.filter(pa.array([model.score(t) < 0.5 for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

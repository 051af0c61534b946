import numpy as np

from riskloom.llm import quality
from riskloom.llm.queries import QUERIES
from llm_fixtures import make_docs  # noqa: F401


def test_held_out_accuracy(spark):
    """The scorer never sees ``labels``: they are held out altogether."""
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r.keep for r in QUERIES["op8_quality"](spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    good = [got[r.doc_id] for r in labels if r.quality == 1]
    junk = [got[r.doc_id] for r in labels if r.quality == 0]
    assert sum(good) >= 0.99 * len(good)
    assert sum(junk) <= 0.02 * len(junk)


def test_em_recovers_planted_labellers():
    rng = np.random.default_rng(2)
    junk = rng.random(20_000) < 0.2
    votes = np.zeros((quality.LABELLERS, 20_000), int)
    hits = np.array([0.9, 0.8, 0.7, 0.6, 0.5, 0.5, 0.4])
    for i in range(quality.LABELLERS):
        p = np.where(junk, hits[i], 0.02)
        votes[i] = np.where(rng.random(20_000) < 0.3, quality.NONE,
                            np.where(rng.random(20_000) < p, quality.JUNK, quality.CLEAN))
    patterns = (votes * 3 ** np.arange(quality.LABELLERS)[:, None]).sum(0)
    u, n = np.unique(patterns, return_counts=True)
    got, share = quality.expectation_maximisation(u, n.astype(float), false_alarm=0.05)
    assert abs(share - 0.2) < 0.02
    assert np.abs(got[1, :, quality.JUNK] - hits).max() < 0.05
    assert np.abs(got[0, :, quality.JUNK] - 0.02).max() < 0.02


def test_sample_of_mostly_copies_has_features(make_docs, monkeypatch):
    """Copies crowd the table, not the sample: each drawn text comes with its features, as in a small table."""
    rows = [(i, f"plain words number {i} in a row of text that says little") for i in range(900)]
    rows += [(1000 + i, "BUY!! NOW!! CHEAP!! " * 9 + "x" * (i % 40)) for i in range(17_000)]
    trained = []
    monkeypatch.setattr(quality, "_train", lambda r, labels: trained.append((r, labels)) or np.zeros(quality.BUCKETS + 1))
    docs = make_docs(rows)
    quality.fit_quality(docs)
    quality.fit_quality(docs, train_rows=300)
    quality.fit_quality(docs.dropDuplicates(["text"]))
    (full, labels), (part, _), (small, _) = trained
    assert len(full) == len(small) == len(labels) == 940 and len(part) == 300
    assert all(full) and all(part) and full == small and part == full[:300]


def test_edge_rows(make_docs):
    rows = [(i, "The quick brown fox jumps over the lazy dog, and runs away from it.") for i in range(30)]
    rows += [(100 + i, "BUY!! NOW!! CHEAP!! " * 9) for i in range(10)]
    rows += [(200, None), (201, ""), (202, " \n"), (None, "short"), (203, "spam " * 40_000), (100, "BUY!! NOW!! CHEAP!! " * 9)]
    docs = make_docs(rows)
    model = quality.fit_quality(docs)
    out = quality.score_quality(docs, model).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert all(by[i].keep for i in [*range(30), 200, 201, 202, None])
    assert not any(by[100 + i].keep for i in range(10))
    kept = quality.keep_quality(docs, model)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(r.doc_id) for r in out if r.keep)


def test_empty_and_all_clean(make_docs):
    docs = make_docs([])
    assert quality.score_quality(docs, quality.fit_quality(docs)).count() == 0
    docs = make_docs([(i, "a plain sentence of some ordinary words %d" % i) for i in range(20)])
    assert quality.keep_quality(docs, quality.fit_quality(docs)).count() == 20

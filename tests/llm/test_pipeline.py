import hashlib
from collections import Counter

import corpus_pipeline
from riskloom.llm import quality
import test_mixing
import test_packing
import test_simhash
from llm_fixtures import make_docs, small_dir  # noqa: F401


def test_every_stage_against_brute_force(spark, small_dir, tmp_path):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    columns = docs.columns
    model = quality.fit_quality(docs)
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small_dir)
        out.write.parquet(f"file://{tmp_path}/{name}")
        out = spark.read.parquet(f"file://{tmp_path}/{name}")
        got = out.collect()
        if name == "quality":
            rows = [r for r in rows if model.score(r[1]) < 0.5]
        elif name == "exact_dedup":
            last = {}
            for r in rows:
                h = hashlib.sha256((r[1] or "").encode()).digest()
                last[h] = max(last.get(h, r), r, key=lambda r: r[0])
            rows = list(last.values())
        elif name == "simhash":
            least = {(i, c) for i, _, c in test_simhash.brute([r[:2] for r in rows])}
            rows = [r for r in rows if (r[0], r[0]) in least]
        elif name == "mixing":
            copies = Counter(r.doc_id for r in got)
            taken = [{"doc_id": i, "size": test_mixing.size(t), "source": s, "copies": copies[i]} for i, t, s in rows]
            sources = sorted({s for *_, s in rows})
            sizes = [sum(r["size"] for r in taken if r["source"] == s) for s in sources]
            goal = dict(zip(sources, test_mixing.mixing.targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(sources))])))
            for r in taken:
                r |= {"taken": r["copies"] * r["size"], "source_size": sizes[sources.index(r["source"])],
                      "target": goal[r["source"]]}
            test_mixing.check(rows, taken)
            rows = [r for r in rows for _ in range(copies[r[0]])]
        if name == "packing":
            test_packing.check(rows, [r.asDict() for r in got])
        else:
            assert out.columns == columns
            assert sorted((r.doc_id, r.text, r.source) for r in got) == sorted(rows)
        kept[name] = len(got)
        docs = out
    run = corpus_pipeline.run(spark, small_dir).drop("sequence_id", "offset")
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, docs.drop("sequence_id", "offset").collect()))
    assert kept["quality"] > kept["exact_dedup"]


def test_stages_on_empty_documents(spark, make_docs):
    docs = make_docs([])
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0
        docs = out if out.columns == docs.columns else docs

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, fp string, size long, key string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents rows from (doc_id, text, source), with extra columns whose names the operators use inside."""
    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None, "x", 1, None) for r in rows]
        return spark.createDataFrame(full, DOC)
    return make


@pytest.fixture(scope="session")
def small_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small_docs(spark, small_dir):
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()]

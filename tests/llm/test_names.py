"""Operators that hand on whole rows leave columns of any name alone."""

import pytest

from riskloom.llm import dedup_exact, lines, mixing, quality, simhash

#: Names that the operators use inside.
INSIDE = ("target source_size block blocks source_no source_name full edge fitting fit_key fit_id shards size row __id "
          "__key __source __no __shard __sha __sha_of_row __lost kept keep_id least node root fp id h score keep task "
          "part copies taken key sha n line_no class_id").split()
TEXT = ["the same words stand here twice and are long enough to count as one line of prose"] * 2 + [
    "another document\nwith two lines of text in it\nwith two lines of text in it", None, "", "a b c d e f g"]


@pytest.fixture(scope="module")
def odd(spark):
    ddl = "Doc_Id long, Text string, Source string, " + ", ".join(f"`{c}` string" for c in INSIDE)
    return spark.createDataFrame([(i, t, "s", *[f"{c}{i}" for c in INSIDE]) for i, t in enumerate(TEXT)], ddl)


def checked(out, odd):
    assert out.columns == odd.columns
    rows = out.collect()
    for r in rows:
        assert all(r[c] == f"{c}{r.Doc_Id}" for c in INSIDE)
    return sorted(r.Doc_Id for r in rows)


def test_mix(odd):
    ids = checked(mixing.mix(odd, doc_id="doc_id", text="text", source="source"), odd)
    assert {0, 1, 2, 5} <= set(ids)  # documents without words weigh nothing and may come along


def test_exact_dedup(odd):
    assert checked(dedup_exact.exact_dedup(odd), odd) == [1, 2, 4, 5]
    twice = odd.unionByName(odd)
    assert checked(dedup_exact.exact_dedup(twice), odd) == [1, 2, 4, 5]


def test_near_dedup(odd):
    assert checked(simhash.near_dedup(odd), odd) == [0, 2, 3, 5]


def test_dedup_lines(odd):
    out = lines.dedup_lines(odd)
    assert checked(out, odd) == list(range(6))
    texts = {r.Doc_Id: r.Text for r in out.collect()}
    assert texts[1] == "" and texts[2] == "another document\nwith two lines of text in it" and texts[3] is None


def test_keep_quality(odd):
    assert set(checked(quality.keep_quality(odd, quality.fit_quality(odd)), odd)) <= set(range(6))

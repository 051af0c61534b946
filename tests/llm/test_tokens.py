import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riskloom.llm import token_counts, tokens, wavelet
from riskloom.llm.queries import QUERIES
from llm_fixtures import make_docs, small_dir, small_docs  # noqa: F401

TEXT = st.lists(st.sampled_from(
    ["a", "B", "é", "ß", " ", "  ", "\n", "\t", " ", " ", "'s", "'ll", "'", "'re", "'r", "'v", "1", "23", ".", ",", "!",
     "<|endoftext|>", "<|startoftext|>", "İ", "́", "中", "문", " ", "\x1c", "Σ", "_", "word", " The", "#", "🙂", "µ",
     " thshion", "inganderth", "Ç"]), max_size=16).map("".join)

ENCODERS = {n: tokens.TextEncoder(tokens.vocabulary(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}
MACHINE = token_counts.Transducer(tokens.vocabulary("byte_bpe_50k.json"))


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_ids_equal_the_library(text):
    for enc in ENCODERS.values():
        assert enc.ids(text) == enc.whole(text)


WORDY = st.lists(st.sampled_from(["a", "B", "é", " ", " ", "\n", "  ", "\x1c", "***", "%%%", "#", "$&", ".", "'s", "<|endoftext|>",
                                  "word", "Ç"]), max_size=12).map("".join)


@pytest.mark.parametrize("together", [1, 20, 1 << 23])
@settings(max_examples=200, deadline=None)
@given(st.lists(WORDY | TEXT, max_size=6))
def test_ids_of_many_texts_equal_the_library(together, texts):
    tokens.TOGETHER, before = together, tokens.TOGETHER
    try:
        for enc in ENCODERS.values():
            assert list(enc.ids_of(texts)) == [enc.whole(t) for t in texts]
    finally:
        tokens.TOGETHER = before


def test_a_word_of_many_texts_is_looked_up_once():
    for name in ENCODERS:
        enc, asked = tokens.TextEncoder(tokens.vocabulary(name)), []
        enc.later = type("Counting", (dict,), {"__getitem__": lambda _, w: asked.append(w) or enc._word(" ", w)})()
        assert len(list(enc.ids_of(["the same words the same words***"] * 50))) == 50
        assert len(asked) <= 5  # same, words, the, words*** and its bare word


@pytest.mark.parametrize("chunk", [1, 3, 8, 1 << 16])
@settings(max_examples=200, deadline=None)
@given(text=TEXT | st.text(max_size=20))
def test_transducer_equals_the_library(chunk, text):
    token_counts.CHUNK, before = chunk, token_counts.CHUNK
    try:
        assert MACHINE.count(text) == len(ENCODERS["byte_bpe_50k.json"].whole(text)) // 4
    finally:
        token_counts.CHUNK = before


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, min_size=3, max_size=3))
def test_chunk_maps_compose_associatively(parts):
    a, b, c = map(MACHINE.chunk_map, parts)
    assert MACHINE.compose(MACHINE.compose(a, b), c) == MACHINE.compose(a, MACHINE.compose(b, c))


def test_memory_stays_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 8)
    monkeypatch.setattr(token_counts, "STATES", 20)
    enc, machine = tokens.TextEncoder(tokens.vocabulary("byte_bpe_50k.json")), token_counts.Transducer(
        tokens.vocabulary("byte_bpe_50k.json"))
    for i in range(40):
        text = f"word{i} some other, longer words {i} again and again."
        assert enc.ids(text) == enc.whole(text) and machine.count(text) == len(enc.whole(text)) // 4
    assert len(enc.later) <= 8 and len(machine.merge.keys) <= 60


ROWS = [(3, "Hello world, it's me.\nNew line."), (1, None), (2, ""), (5, " \n\t  x"), (4, "<|endoftext|> a <|endoftext|>"),
        (4, "<|endoftext|> a <|endoftext|>"), (7, "word " * 30_000), (8, "x" * 20_000), (9, "naïve ﬁ 中文 12.5%")]


def library_ids(text):
    return np.frombuffer(ENCODERS["byte_bpe_50k.json"].whole(text or ""), "<u4")


def counted(rows):
    return sorted((i, len((t or "").encode()), len(library_ids(t)), len(library_ids(t)) > 1024) for i, t, *_ in rows)


def test_token_counts(make_docs, spark, small_dir, small_docs):
    assert sorted(map(tuple, token_counts.token_counts(make_docs(ROWS)).collect())) == counted(ROWS)
    assert sorted(map(tuple, QUERIES["op4_token_counts"](spark, small_dir).collect())) == counted(small_docs)
    assert token_counts.token_counts(make_docs([])).count() == 0


def stored(rows):
    out, at = [], 0
    for i, t, *_ in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = np.append(library_ids(t), 0).astype("<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_wavelet_query(spark, small_dir, small_docs):
    got = [tuple(r) for r in QUERIES["op7_wavelet"](spark, small_dir).collect()]
    assert sorted(got) == stored(small_docs)


def test_wavelet_files(make_docs, spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/files"
    wavelet.write_wavelet(make_docs(ROWS).repartition(3), path)
    read = wavelet.with_starts(spark, path, wavelet.read_documents(spark, path))
    got = sorted((r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in read.collect())
    assert got == stored(ROWS)
    everything = {}
    for i, t, *_ in ROWS:
        for p, token in enumerate([*library_ids(t).tolist(), 0]):
            everything.setdefault(token, []).append((i, p))
    for token in (0, 50256, int(library_ids(" a")[0]), int(library_ids(" word")[0]), 49_999, 70_000):
        places = sorted(everything.get(token, []))
        assert wavelet.token_counts_in(spark, path, token).groupBy().sum("n").first()[0] == len(places)
        if len(places) < 100:
            assert sorted(map(tuple, wavelet.token_occurrences(spark, path, token).collect())) == places
    empty = f"file://{tmp_path}/empty"
    wavelet.write_wavelet(make_docs([]), empty)
    assert wavelet.read_documents(spark, empty).count() == 0


@pytest.mark.parametrize("n", [0, 1, 7, 4096, 4097, 20_000])
def test_wavelet_matrix(n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 300, n).astype(np.uint16)
    w = wavelet.WaveletMatrix.build(ids, 9)
    assert (w.decode() == ids).all()
    for i in rng.integers(0, n, 20).tolist() if n else []:
        assert w.access(i) == ids[i]
        token = int(ids[i])
        where = np.flatnonzero(ids == token)
        a, b = sorted(rng.integers(0, n + 1, 2).tolist())
        assert w.count(token, a, b) == ((where >= a) & (where < b)).sum()
        k = int(rng.integers(0, len(where)))
        assert w.select(token, k) == where[k] and w.select(token, len(where)) == -1
    assert w.count(511) == 0 and w.count(1 << 9) == 0 and w.select(1 << 9, 0) == -1


def test_ids_of_cuts_no_more_texts_at_once_than_told():
    enc, taken = tokens.encoder(tokens.vocabulary("word_bpe_49k.json")), []
    texts = [f"line {i} of some words\nand more" for i in range(100)]
    ids = enc.ids_of((taken.append(t) or t for t in texts), 200)
    first = next(ids)
    assert sum(map(len, taken)) < 200 + len(texts[0]) + 2
    assert [first, *ids] == [enc.whole(t) for t in texts]

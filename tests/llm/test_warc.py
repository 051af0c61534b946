import gzip
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from riskloom.llm import warc
from riskloom.llm.store import shared_folder

PAGE = "page_id long, url string, html string, key string, sha string, payload string, keep_id long"


def make(spark, rows):
    return spark.createDataFrame([(*r, "k", "s", "p", 1) for r in rows], PAGE)


def expected(rows):
    top = {}
    for page, _, html in rows:
        if page is not None:
            top[html or ""] = max(top.get(html or "", page), page)
    out = []
    for page, _, html in rows:
        data, most = (html or "").encode(), top.get(html or "")
        revisit = len(data) >= 1000 and most is not None and page != most
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response",
                    most if revisit else None))
    return sorted(out, key=repr)


def index(spark, rows):
    files = warc.write_warc(make(spark, rows), shared_folder(spark, "warc-test"))
    got = warc.capture_index(warc.assemble(warc.read_records(files, with_payload=False))).collect()
    return sorted((tuple(r) for r in got), key=repr)


EDGE = [(1, "http://a/x", "short"), (2, "http://a/x", "short"), (3, None, None), (4, "", ""),
        (5, "http://b/é ?q=1\r\nX: y", "é" * 500), (6, "http://b/", "é" * 500), (7, "http://b/", "é" * 499 + "x"),
        (8, "http://[bad", "HTTP/1.1 200 OK\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 30),
        (9, "u", "a" * 2_000_000), (10, "u", "a" * 2_000_000), (10, "u", "a" * 2_000_000), (None, "u", "b" * 1000),
        (11, "u", "b" * 1000), (None, "u", "c" * 1000), (None, "u", "c" * 1000), (1, "http://a/x", "short"),
        (-4, "u", "b" * 1000), (12, "u", "\x00\x1f\x8b" * 400)]


def test_edges(spark):
    assert index(spark, EDGE) == expected(EDGE)


def test_large_group_and_file_ends(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 4096)
    rng = random.Random(3)
    rows = [(i, f"http://h/{i}", rng.choice(["z" * 1500, "y" * 999, str(i) * 400])) for i in range(300)]
    assert index(spark, rows) == expected(rows)


def test_empty_table(spark):
    assert index(spark, []) == []


def test_captures_hold_request_response_and_metadata(spark):
    folder = shared_folder(spark, "warc-test")
    files = warc.write_warc(make(spark, EDGE), folder)
    captures = warc.assemble(warc.read_records(files)).collect()
    assert len(captures) == len(EDGE)
    for c in captures:
        assert c.request.record_id == c.capture_id and c.request.record_type == "request"
        assert c.request.http.startswith("GET ") and len(c.metadata) == 1
        assert (c.response.payload is None) == (c.response.record_type == "revisit")
        if c.response.payload is not None:
            assert hashlib.sha1(c.response.payload).hexdigest() == c.response.payload_digest
    payloads = [c.response.payload for c in captures if c.response.record_type == "response"]
    assert {p.decode() for p in payloads} == {h or "" for _, _, h in EDGE}
    # the manifest alone says which files count; a general reader lists the folder
    assert warc.archive_files(spark, folder).count() == files.count()
    path = files.first()["path"].removeprefix("file://").removeprefix("file:")
    with open(path, "rb") as f:
        plain = gzip.decompress(f.read())
    assert plain.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and plain.endswith(b"\r\n\r\n")
    assert [h["warc-type"] for h, _ in warc.records_of(io.BytesIO(plain))][:2] == ["warcinfo", "request"]


def test_lost_attempts_are_not_read(spark):
    folder = shared_folder(spark, "warc-test")
    files = warc.write_warc(make(spark, EDGE[:2]), folder)
    store, root = warc.open_store(folder)
    with store.open_output_stream(f"{root}/alone-000000-999-00000.warc.gz", compression=None) as out:
        out.write(b"\x1f\x8b half")
    assert warc.read_records(files).where("record_type = 'response'").count() == 2


def test_foreign_archives(spark):
    """Records of a capture in several files, uncompressed, digests in hex or absent, captures with parts missing."""
    folder = shared_folder(spark, "warc-test")
    store, root = warc.open_store(folder)
    body = b"HTTP/1.1 200 OK\r\nX: 1\r\n\r\nhello"
    a = warc.render([("WARC-Type", "response"), ("WARC-Record-ID", "<r1>"), ("Content-Type", "application/http")], body)
    b = warc.render([("WARC-Type", "request"), ("WARC-Record-ID", "<q1>"), ("WARC-Concurrent-To", "<r1>"),
                     ("Content-Type", "application/http")], b"GET / HTTP/1.1\r\n\r\n")
    b += warc.render([("WARC-Type", "response"), ("WARC-Record-ID", "<r2>"), ("Content-Type", "application/http"),
                      ("WARC-Payload-Digest", "sha1:" + hashlib.sha1(b"hello").hexdigest().upper())], body)
    for name, data in (("a.warc", a), ("b.warc", b), ("c.warc", b"")):
        with store.open_output_stream(f"{root}/{name}", compression=None) as out:
            out.write(data)
    got = {c.capture_id: c for c in warc.assemble(warc.read_records(warc.archive_files(spark, folder))).collect()}
    assert set(got) == {"<r1>", "<r2>"}
    assert got["<r1>"].request.record_id == "<q1>" and got["<r2>"].request is None and got["<r2>"].metadata == []
    assert {bytes(c.response.payload) for c in got.values()} == {b"hello"}
    assert {c.response.payload_digest for c in got.values()} == {hashlib.sha1(b"hello").hexdigest()}


@pytest.mark.parametrize("data", [b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc", b"nonsense\r\n", b"WARC/1.1\r\nX",
                                  warc.member(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")[:-9]])
def test_broken_files_are_errors(data):
    with pytest.raises(ValueError):
        list(warc.records_of(io.BytesIO(data)))


def test_changed_payload_is_an_error():
    record = warc.capture_records(1, "u", b"abc", "d", "t", 0)[1].replace(b"abc", b"abd")
    (headers, block), = warc.records_of(io.BytesIO(record))
    with pytest.raises(ValueError):
        warc.parse(headers, block, True)


def test_field_of_metadata(spark):
    files = warc.write_warc(make(spark, EDGE), shared_folder(spark, "warc-test"))
    urls = warc.assemble(warc.read_records(files)).select(warc.field("metadata", "url").alias("u"))
    import json
    assert sorted((json.loads(r.u) for r in urls.collect()), key=repr) == sorted((u for _, u, _ in EDGE), key=repr)
    assert files.agg(F.sum("records")).first()[0] == 3 * len(EDGE)

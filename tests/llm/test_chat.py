import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskloom.llm import chat
from riskloom.llm.queries import QUERIES
from llm_fixtures import small_dir  # noqa: F401

SCHEMA = "conv_id long, turn long, role string, content " + chat.PART + ", formatted string, turns int"


def escaped(t):
    return t.replace("\\", "\\b").replace("<", "\\l").replace(">", "\\g")


def turns(spark, rows):
    return spark.createDataFrame([(c, t, r, None if p is None else [(k, x, ref, n) for k, x, ref, n in p], "f", 1)
                                  for c, t, r, p in rows], SCHEMA)


def text(x):
    return [("text", x, None, None)]


def test_parts_and_attachments(spark):
    rows = [(1, 1, "assistant", [("text", "see <image 0>", None, None), ("image", None, "b.png", 2), ("text", "!", None, None)]),
            (1, 0, "user", [("image", None, "a.png", 4), ("audio", "x", "c.wav", 10), ("text", "hi\n", None, None)]),
            (1, 2, "user", [("document", None, "d.pdf", None)]), (2, 0, "user", None), (2, 0, "user", []),
            (None, None, None, text("\\b<"))]
    got = {r.conv_id: r for r in chat.format_chat(turns(spark, rows)).collect()}
    one = got[1]
    assert one.formatted == ("<turn user><image 0><audio 1>hi\n</turn>\n<turn assistant>see \\limage 0\\g<image 2>!</turn>\n"
                             "<turn user><document 3></turn>\n")
    assert [(a.number, a.type, a.ref, a.tokens) for a in one.attachments] == [
        (0, "image", "a.png", 1024), (1, "audio", "c.wav", 250), (2, "image", "b.png", 512), (3, "document", "d.pdf", 800)]
    assert one.expanded_tokens == 2586
    (span,) = one.loss_spans
    assert one.formatted[span.start:span.start + span.length] == "see \\limage 0\\g<image 2>!"
    assert got[2].formatted == "<turn user></turn>\n" * 2 and got[None].formatted == "<turn >\\bb\\l</turn>\n"
    assert chat.format_chat(turns(spark, []).where("false")).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "a<b>\\"]), st.text(
    st.sampled_from(list("ab\\<>/ \nturn#:é🙂bl")), max_size=30)), min_size=1, max_size=5))
def test_round_trip(spark, said):
    rows = [(c, i, r, text(x)) for c in (1, 2) for i, (r, x) in enumerate(said)]
    for back in chat.read_chat(chat.format_chat(turns(spark, rows))).collect():
        assert [(t.role, t.text) for t in back.turns] == said
        assert back.loss_text == "".join(x for r, x in said if r == "assistant")
        assert back.formatted_chars == sum(len("<turn ></turn>\n") + len(escaped(r)) + len(escaped(x)) for r, x in said)


def test_long_and_repeated_turns(spark):
    rows = [(1, i % 3, "assistant", text("x<" * 20_000)) for i in range(6)]
    (back,) = chat.read_chat(chat.format_chat(turns(spark, rows))).collect()
    assert len(back.turns) == 6 and back.loss_text == "x<" * 120_000


def test_query_equals_brute_force(spark, small_dir):
    rows = [(r.conv_id, r.turn, r.role, r.text or "") for r in spark.read.parquet(f"{small_dir}/conversations.parquet").collect()]
    planted = "\\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", planted), (-7, 1, "assistant", planted)]
    expected = []
    for c in {r[0] for r in rows}:
        own = sorted(r[1:] for r in rows if r[0] == c)
        loss = "".join(x for _, r, x in own if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        expected.append((c, len(own), sha("".join(f"{r}\n{x}\n" for _, r, x in own)), len(loss), sha(loss)))
    got = [tuple(r)[:5] for r in QUERIES["op6_chat"](spark, small_dir).collect()]
    assert sorted(got) == sorted(expected)


def test_main_path_is_native(spark):
    plan = chat.read_chat(chat.format_chat(turns(spark, [(1, 0, "user", text("a"))])))
    shown = plan._jdf.queryExecution().toString()
    assert not any(w in shown for w in ("Python", "Pandas", "Arrow")) and isinstance(F.lit(1), object)

"""Chat formatting of typed content parts, in DataFrame functions only.

A turn's content is an array of parts ``(type, text, ref, units)``.  The
visitor has one rule per part type: text is escaped; image, audio and document
parts become placeholders ``<image 0>``, numbered in order of the attachments
of the conversation, with their reference and expanded token count recorded.

Template of a turn: ``<turn ROLE>CONTENT</turn>`` and a line feed.  Inside
texts and roles a backslash becomes ``\\b``, ``<`` becomes ``\\l`` and ``>``
becomes ``\\g``, so markers and placeholders only ever come from the template,
and any text reads back as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens a unit of an attachment expands to: an image tile, a second of audio, a page.
EXPANSION = {"image": 256, "audio": 25, "document": 800}
PART = "array<struct<type:string,text:string,ref:string,units:long>>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit(">"),
                     F.lit("\\g"))


def unescape(c: Column) -> Column:
    """The reverse: every backslash of an escaped text begins an escape, so the order of the marks before ``\\b`` is free."""
    return F.replace(F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">")), F.lit("\\b"),
                     F.lit("\\"))


def text_parts(text: Column) -> Column:
    """A plain text as content: one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"),
                            F.lit(None).cast("long").alias("units"))).cast(PART)


def _is_attachment(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")).isin(*EXPANSION)


def _visit(part: Column, number: Column) -> Column:
    """The placeholder of an attachment with its number in the conversation, or the escaped text of any other part."""
    return F.when(_is_attachment(part), F.concat(F.lit("<"), part["type"], F.lit(" "), number.cast("string"),
                                                 F.lit(">"))).otherwise(escape(F.coalesce(part["text"], F.lit(""))))


def _expanded(part: Column) -> Column:
    cost = F.lit(0)
    for kind, tokens in EXPANSION.items():
        cost = F.when(part["type"] == kind, F.lit(tokens)).otherwise(cost)
    return (cost * F.coalesce(part["units"], F.lit(1))).cast("long")


def format_chat(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                content: str = "content", learn: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (start from 0 and length in code points of the content
    of each ``learn`` turn), attachments (number, type, ref, tokens), expanded_tokens.

    Turns are ordered by ``turn`` (null first); ties, repeated rows among them, by role, then content, and all stay.
    A null conversation id is a conversation of its own; a null role is empty; null content or text is empty.
    An empty table gives no rows; other columns are ignored.
    """
    one = F.struct(turns[turn].alias("turn"), F.coalesce(turns[role].cast("string"), F.lit("")).alias("role"),
                   F.coalesce(turns[content].cast(PART), F.array().cast(PART)).alias("parts"))
    rows = turns.select(turns[conv_id].alias("conv_id"), one.alias("t")).groupBy("conv_id").agg(
        F.array_sort(F.collect_list("t")).alias("turns"))
    # number the attachments in order: all parts of the conversation, then the attachments among them before each turn
    rows = rows.withColumn("own", F.transform("turns", lambda t: F.size(F.filter(t["parts"], _is_attachment))))
    rows = rows.withColumn("before", F.transform("turns", lambda t, i: F.aggregate(
        F.slice("own", F.lit(1), i), F.lit(0), lambda a, x: a + x)))

    def body(t: Column, first: Column) -> Column:
        return F.concat_ws("", F.transform(t["parts"], lambda p, k: _visit(p, first + F.size(F.filter(
            F.slice(t["parts"], F.lit(1), k), _is_attachment)))))

    rows = rows.withColumn("pieces", F.transform("turns", lambda t, i: F.struct(
        t["role"].alias("role"), F.concat(F.lit("<turn "), escape(t["role"]), F.lit(">")).alias("head"),
        body(t, F.element_at("before", i + 1)).alias("body"))))
    rows = rows.withColumn("formatted", F.concat_ws("", F.transform("pieces", lambda p: F.concat(
        p["head"], p["body"], F.lit("</turn>\n")))))
    # spans: a running length over the pieces
    walk = F.aggregate(
        "pieces", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda a, p: F.struct(
            (a["at"] + F.length(p["head"]) + F.length(p["body"]) + F.lit(len("</turn>\n"))).alias("at"),
            F.when(p["role"] == learn, F.concat(a["spans"], F.array(F.struct(
                (a["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length")))))
            .otherwise(a["spans"]).alias("spans")))
    refs = F.transform(F.filter(F.flatten(F.transform("turns", lambda t: t["parts"])), _is_attachment),
                       lambda p, i: F.struct(i.alias("number"), p["type"].alias("type"), p["ref"].alias("ref"),
                                             _expanded(p).alias("tokens")))
    rows = rows.select("conv_id", "formatted", walk["spans"].alias("loss_spans"), refs.alias("attachments"))
    return rows.withColumn("expanded_tokens", F.aggregate(
        "attachments", F.lit(0).cast("long"), lambda a, r: a + F.coalesce(r["tokens"], F.lit(0).cast("long"))))


def read_chat(formatted: DataFrame) -> DataFrame:
    """Read formatted conversations back: conv_id, turns (role, text), loss_text (all text under the mask, unescaped)."""
    # a marker's "<" is never inside a text, so the line ends of turns are found by plain search
    pieces = F.filter(F.split("formatted", "</turn>\n", -1), lambda p: p != "")
    turns = F.transform(pieces, lambda p: F.struct(
        unescape(F.substring_index(F.substr(p, F.lit(len("<turn ") + 1)), ">", 1)).alias("role"),
        unescape(F.substr(p, F.length(F.substring_index(p, ">", 1)) + 2)).alias("text")))
    masked = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"])))
    return formatted.select("conv_id", turns.alias("turns"), F.concat_ws("", masked).alias("loss_text"),
                            F.length("formatted").cast("long").alias("formatted_chars"))

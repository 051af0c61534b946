"""Fuzzy line dedup by MinHash, in DataFrame functions only.

Lines are the pieces of a text between line feeds; blank ones, without a word
of the contracts, take no part.  Other line ends are characters like any other.
Equal lines share an id (the 64-bit hash of the line), and each distinct line is
signed once.  A line's signature is taken over all its hashed five-character
shingles, whatever its length: the set whose similarity is verified.  The hash
space has ``BANDS`` starting points, and a band is the ``ROWS`` smallest hashes
from one of them on (around the end, at the last ones): ``ROWS`` minima of a
MinHash each.

Lines of few shingles have too few minima for that, so their bands are exact.
Of two similar sets each has at least ``SIMILAR`` of its n hashes in common with
the other, so the two smallest common ones are among the first
n - ceil(SIMILAR n) + 2 of either; every two of those are a band.  Lines of up to
``FEW`` shingles have such bands, lines of ``MANY`` and more those of minima; a
set of more than ``FEW`` is similar to none of fewer than ``MANY``.

Lines that share a band are candidates, and the exact Jaccard similarity of
all their five-character shingles decides.  A bucket is not paired up: its
members are first compared with its smallest member, and after a union-find
only members of different components are compared with each other.  Union-find
over all verified links gives the classes; the first line of a class is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import WORD, save, text_of

SIMILAR, SHINGLE = 0.8, 5
BANDS, ROWS = 12, 5
FEW, MANY = 30, 25
#: One in so many of a line's hashes is a mark by which starting points are found.
STEP = 16
#: Bits of the filter that tells which lines must be read again: 2 MB, whatever the input.
FILTER_BITS = 24

#: Every window of characters, line ends included; the dot after it steps over whole surrogate pairs.
_EVERY = rf"(?s)(?=(.{{{SHINGLE}}}))."


def lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text_key, line_no from 0, line) of every line of every row."""
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), text_of(docs, text).alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("text_key"),
                       F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def shingles(line: Column) -> Column:
    """All distinct shingles of ``SHINGLE`` characters; a shorter line is its own."""
    return F.array_distinct(_windows(line))


def _windows(line: Column) -> Column:
    return F.when(F.length(line) < SHINGLE, F.array(line)).otherwise(
        F.regexp_extract_all(line, F.lit(_EVERY), F.lit(1)))


def _hashes(found: Column) -> Column:
    return F.sort_array(F.array_distinct(F.transform(found, lambda s: F.xxhash64(s))))


def _bands(hashes: Column, kind: int) -> Column:
    """Bands of ``ROWS`` minima, for lines of ``MANY`` shingles and more.  The hashes are in order: every ``STEP``-th of
    them tells where a starting point lies, and only those near it are looked at."""
    marks = F.transform(F.sequence(F.lit(0), F.size(hashes) - 1, F.lit(STEP)), lambda k: F.get(hashes, k))

    def band(i: int, marks: Column) -> Column:
        first = F.slice(hashes, 1, ROWS)
        if i:
            start = F.expr(f"{-(1 << 63) + i * ((1 << 64) // BANDS)}L")
            below = F.size(F.filter(marks, lambda h: h < start))
            near = F.slice(hashes, F.greatest((below - 1) * STEP, F.lit(0)) + 1, F.lit(STEP + ROWS))
            first = F.slice(F.concat(F.filter(near, lambda h: h >= start), first), 1, ROWS)
        return F.xxhash64(first, F.lit(100 * kind + i))

    # an array of one: the marks are found once for all bands
    return F.transform(F.array(marks), lambda m: F.array(*(band(i, m) for i in range(BANDS))))[0]


def _exact_bands(hashes: Column) -> Column:
    """Every two of the first n - ceil(SIMILAR n) + 2 hashes (a single one alone), for lines of up to ``FEW``."""
    n = F.size(hashes)
    first = F.slice(hashes, F.lit(1), n - F.ceil(n * F.lit(SIMILAR).cast("decimal(2,1)")).cast("int") + 2)
    pairs = F.flatten(F.transform(first, lambda x, i: F.transform(
        F.slice(first, i + 2, F.size(first)), lambda y: F.xxhash64(x, y, F.lit(100)))))
    return F.when(n == 1, F.array(F.xxhash64(hashes[0], F.lit(100)))).otherwise(pairs)


def signatures(rows: DataFrame) -> DataFrame:
    """(id, bands) of each row of ``rows(id, line)``."""
    n, none = F.size("h"), F.array().cast("array<long>")
    h = F.col("h")
    return rows.select("id", _hashes(_windows(F.col("line"))).alias("h")).select("id", F.concat(
        F.when(n <= FEW, _exact_bands(h)).otherwise(none), F.when(n >= MANY, _bands(h, 0)).otherwise(none)).alias("bands"))


def _filter_table(ids: DataFrame) -> DataFrame:
    """Bitmap of the ids' low bits as at most 512 rows (at, bits) of 4 KB."""
    slot = F.col("id").bitwiseAND((1 << FILTER_BITS) - 1)
    return ids.select(F.shiftright(slot, 15).alias("at"), slot.bitwiseAND(32767).alias("pos")).groupBy("at").agg(
        F.bitmap_construct_agg("pos").alias("bits"))


def _texts(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, line, n shingles) for ``ids``: the bitmap drops nearly all other lines before anything moves."""
    slot = F.col("id").bitwiseAND((1 << FILTER_BITS) - 1)
    pos = slot.bitwiseAND(32767)
    byte = F.conv(F.hex(F.substr(F.col("bits"), (F.shiftright(pos, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    # bounded by construction: 512 rows of 4 KB
    near = rows.withColumn("at", F.shiftright(slot, 15)).join(F.broadcast(_filter_table(ids)), "at").where(
        F.call_function("getbit", byte, pos.bitwiseAND(7).cast("int")) == 1)
    found = near.select("id", "line").join(ids, "id", "left_semi").groupBy("id").agg(F.min("line").alias("line"))
    return found.withColumn("n", F.size(shingles(F.col("line"))))


def similar_pairs(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of ``pairs(u, v)``, those whose lines have a Jaccard similarity of at least ``SIMILAR``."""
    # a set can't be this similar to one that is much larger: most pairs end here, before any text is read
    sizes = texts.select("id", "n")
    pairs = pairs.join(sizes.select(F.col("id").alias("u"), F.col("n").alias("m")), "u").join(
        sizes.withColumnRenamed("id", "v"), "v").where(F.least("m", "n") >= SIMILAR * F.greatest("m", "n"))
    both = pairs.select("u", "v").join(texts.select(F.col("id").alias("u"), F.col("line").alias("a")), "u").join(
        texts.select(F.col("id").alias("v"), F.col("line").alias("b")), "v")
    both = both.select("u", "v", shingles(F.col("a")).alias("a"), shingles(F.col("b")).alias("b"))
    common = F.size(F.array_intersect("a", "b"))
    return both.where((common > 0) & (common >= SIMILAR * (F.size("a") + F.size("b") - common))).select("u", "v")


def line_classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per line of every row: doc_id, text_key, line_no, class_id (null for blank lines), kept.

    Lines linked by a similarity of ``SIMILAR`` or more, directly or through others, are a class; its first line by
    (doc_id, text_key, line_no) is kept, null doc_ids first, and so are blank lines.  Repeated rows (same id and text)
    share their decisions.  Null text counts as empty: one blank line.  An empty table gives no rows.
    """
    all_lines = lines(docs, text, doc_id).withColumn("blank", ~F.col("line").rlike(WORD))
    rows = all_lines.where("not blank").select("doc_id", "text_key", "line_no", F.xxhash64("line").alias("id"), "line")
    table = save(all_lines.select("doc_id", "text_key", "line_no", F.when(~F.col("blank"), F.xxhash64("line")).alias("id")),
                 "lines")
    distinct = save(rows.select("id", "line").distinct(), "distinct-lines")
    entries = save(signatures(distinct), "line-bands").select("id", F.explode("bands").alias("band"))
    buckets = save(entries.groupBy("band").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1"),
                   "buckets")
    members = save(entries.join(buckets, "band"), "members")
    first = save(members.where("id <> rep").select(F.col("rep").alias("u"), F.col("id").alias("v")).distinct(), "pairs")
    texts = save(_texts(distinct, members.select("id").distinct()), "texts")
    links = save(similar_pairs(first, texts), "links")

    roots = save(components(links), "roots")
    rooted = members.where("n > 2").join(roots.select(F.col("node").alias("id"), F.col("root").alias("c")), "id", "left")
    rooted = rooted.join(roots.select(F.col("node").alias("rep"), F.col("root").alias("rc")), "rep", "left").select(
        "band", "id", F.coalesce("c", "id").alias("c"), F.coalesce("rc", "rep").alias("rc"))
    rooted = save(rooted, "rooted")
    rest = rooted.where("c <> rc").select("band", F.col("id").alias("u"), F.col("c").alias("cu"))
    cross = rooted.select("band", F.col("id").alias("v"), F.col("c").alias("cv"), F.col("rc")).join(rest, "band").where(
        "cu <> cv and (u < v or cv = rc)").select("u", "v").distinct()
    if not rest.isEmpty():
        links = links.unionByName(save(similar_pairs(cross, texts), "links"))
        roots = save(components(links), "roots")

    named = table.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("class_id", F.coalesce("root", "id"))
    at = F.struct("doc_id", "text_key", "line_no")
    # a class of one line that occurs once keeps it; only the others meet
    firsts = named.where("class_id is not null").groupBy("class_id").agg(F.min(at).alias("first"))
    return named.join(firsts, "class_id", "left").select(
        "doc_id", "text_key", "line_no", "class_id", F.coalesce(at == F.col("first"), F.lit(True)).alias("kept"))


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with the lines that are not kept taken out of each text; all columns, whatever their names, and all rows
    stay.  Null and empty texts stay as they are; repeated rows lose the same lines."""
    lost = line_classes(docs, text, doc_id).where("not kept").groupBy(
        F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).agg(
        F.collect_set("line_no").alias("__lost"))  # lines of one document
    body = text_of(docs, text)
    kept = F.array_join(F.filter(F.split(body, "\n", -1), lambda x, i: ~F.array_contains(lost["__lost"], i)), "\n")
    left = F.when(lost["__lost"].isNull(), docs[text]).otherwise(kept)
    return docs.join(lost, docs[doc_id].cast("long").eqNullSafe(lost["__id"]) & (F.xxhash64(body) == lost["__key"]),
                     "left").select(*(left.alias(c) if c.lower() == text.lower() else docs[f"`{c}`"] for c in docs.columns))

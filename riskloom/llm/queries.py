"""Queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat, dedup_exact, lines, mixing, packing, quality, search, simhash, token_counts, trie, vector_codes,
               warc, wavelet)
from .store import save, shared_folder


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_exact.exact_groups(_read(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(_read(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_classes(_read(spark, sf_dir, "documents")).select("doc_id", "line_no", "class_id", "kept")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_read(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id",
                         "offset")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    planted = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(
        F.col("id") == 0, "user").otherwise("assistant").alias("role"), planted.alias("text"))
    turns = turns.unionByName(extra).withColumn("content", chat.text_parts(F.coalesce("text", F.lit(""))))
    back = chat.read_chat(chat.format_chat(turns))
    lines = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                       F.sha2(lines, 256).alias("turns_sha256"),
                       F.length("loss_text").cast("long").alias("loss_chars"),
                       F.sha2(F.col("loss_text"), 256).alias("loss_sha256"), "formatted_chars")


def op7_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "wavelet") + "/files"
    wavelet.write_wavelet(_read(spark, sf_dir, "documents"), path)
    back = wavelet.read_documents(spark, path).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return wavelet.with_starts(spark, path, back).select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit_quality(docs))


def op9_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: the whole texts of all rows whose doc_id is divisible by 50."""
    docs = _read(spark, sf_dir, "documents")
    return search.top_k(docs, docs.where("doc_id % 50 = 0")).withColumn("score", F.round("score", 6))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_read(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation c shares its first crc32(c) % 6 turns with the conversation that begins its hundred."""
    lists = trie.turn_lists(_read(spark, sf_dir, "conversations"))
    heads = lists.where("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, 5).alias("head"))
    n = (F.crc32(F.col("conv_id").cast("string")) % 6).cast("int")
    rebuilt = lists.join(heads, F.col("conv_id") - F.col("conv_id") % 100 == F.col("base"), "left").withColumn(
        "n", n).select("conv_id", F.concat(
            F.coalesce(F.slice("head", F.lit(1), F.col("n")), F.slice("turns", 1, 0)),
            F.slice("turns", F.col("n") + 1, F.size("turns"))).alias("turns"))
    return trie.prefix_trie(rebuilt)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write_warc(_read(spark, sf_dir, "pages"), shared_folder(spark, "warc") + "/files")
    # the three sides of a capture come from one reading of the archives
    records = save(warc.read_records(files, with_payload=False), "warc-records")
    return warc.capture_index(warc.assemble(records))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = vector_codes.encode_vectors(_read(spark, sf_dir, "embeddings"))
    return vector_codes.with_label_errors(codes.rows).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error",
        F.lit(codes.digest()).alias("codebooks_sha256"))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_mixing": op2_mixing,
    "op3_line_dedup": op3_line_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_packing": op5_packing,
    "op6_chat": op6_chat,
    "op7_wavelet": op7_wavelet,
    "op8_quality": op8_quality,
    "op9_search": op9_search,
    "op10_simhash": op10_simhash,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_warc": op12_warc,
    "op13_vector_codes": op13_vector_codes,
}


def _trie_sql() -> str:
    """Every prefix of every rebuilt conversation, grouped; crc32 bit by bit, as SQL has none."""
    byte = ("list_reduce(range(8), lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), "
            "xor(c, b) & 255)")
    return f"""
        WITH turns AS (
            SELECT conv_id, list([coalesce(role, ''), coalesce(text, '')]
                                 ORDER BY turn NULLS FIRST, role, text) AS t
            FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
        drawn AS (
            SELECT conv_id, t, xor(list_reduce(
                list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
                lambda c, b: xor(c >> 8, {byte}), 4294967295::BIGINT), 4294967295) % 6 AS h FROM turns),
        rebuilt AS (
            SELECT d.conv_id, list_concat(coalesce(b.t[1:d.h], []), d.t[d.h + 1:]) AS t
            FROM drawn d LEFT JOIN turns b ON b.conv_id = d.conv_id - d.conv_id % 100),
        prefixes AS (
            SELECT conv_id, unnest(range(len(t) + 1)) AS depth, t FROM rebuilt),
        nodes AS (
            SELECT depth, t[1:depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs,
                   CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * length(t[1:depth][depth][2]) END AS saved,
                   sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)
                                   FILTER (WHERE len(t) = depth), '')) AS ends_sha256
            FROM prefixes GROUP BY depth, t[1:depth]),
        kids AS (SELECT depth - 1 AS depth, path[1:depth - 1] AS path, count(*) AS n FROM nodes
                 WHERE depth > 0 GROUP BY 1, 2),
        full_ AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (depth, path)),
        up AS (SELECT unnest(range(depth + 1)) AS depth, path, saved, (n_children = 0)::INT AS leaf FROM full_),
        under AS (SELECT depth, path[1:depth] AS path, sum(saved)::BIGINT AS saved_tokens, sum(leaf)::BIGINT AS n_leaves
                  FROM up GROUP BY 1, 2)
        SELECT f.conv_id, f.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children,
               u.n_leaves, u.saved_tokens, f.ends_sha256
        FROM full_ f JOIN under u USING (depth, path)
        LEFT JOIN nodes p ON p.depth = f.depth - 1 AND p.path = f.path[1:f.depth - 1]
    """


def _codes_sql(parts: int = 4, rounds: int = 4) -> str:
    """Lloyd by full comparison in every round."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
        near{r} AS (
            SELECT vec_id, label, x.part, v, min((list_sum(list_transform(list_zip(v, c),
                       lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e)) AS hit
            FROM parts x JOIN book{r} USING (part) GROUP BY vec_id, label, x.part, v)""")
        if r < rounds:
            steps.append(f"""
        mean{r} AS (
            SELECT part, e, list(m::BIGINT ORDER BY i) AS c FROM (
                SELECT part, hit[2] AS e, i, floor(sum(v[i])::DOUBLE / count(*)) AS m
                FROM near{r}, range(1, 17) r(i) GROUP BY 1, 2, 3) GROUP BY 1, 2),
        book{r + 1} AS (SELECT part, e, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN mean{r} m USING (part, e))""")
    return f"""
        WITH kept AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
            FROM embeddings WHERE embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        parts AS (SELECT vec_id, label, p AS part, v[p * 16 + 1:p * 16 + 16] AS v FROM kept, range({parts}) t(p)),
        book0 AS (
            SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, v AS c FROM parts
            QUALIFY e < 256),{",".join(steps)},
        coded AS (
            SELECT vec_id, label, string_agg(printf('%02x', hit[2]::INT), '' ORDER BY part) AS code,
                   sum(hit[1])::BIGINT AS error FROM near{rounds} GROUP BY vec_id, label)
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
               (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) FROM book{rounds})
                   AS codebooks_sha256
        FROM coded
    """


#: These are SQL; the other operators draw, hash with seeds, call a tokenizer or fit and are tested against brute force.
ORACLES = {
    "op11_prefix_trie": _trie_sql(),
    "op12_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n,
                   max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages)
        SELECT page_id, n::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
               CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to
        FROM p
    """,
    "op13_vector_codes": _codes_sql(),
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op6_chat": """
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok')
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), ''))
                   AS loss_sha256,
               sum(length('<turn ' || role || '></turn>') + 1 + 2 * length(text)
                   - length(replace(replace(replace(text, '\\', ''), '<', ''), '>', '')))::BIGINT AS formatted_chars
        FROM t GROUP BY conv_id
    """,
}

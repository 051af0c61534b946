"""The corpus pipeline: documents -> clean, distinct, mixed, packed sequences.

Each stage works on all rows its predecessor kept and is written before the
next one reads it; the last returns the packed pieces.  In every stage a null
text counts as empty, an empty table gives no rows, and columns may have any
names; what becomes of empty texts and repeated rows is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import dedup_exact, mixing, packing, quality, simhash
from riskloom.llm.store import shared_folder


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.  Empty texts stay; repeated rows fare alike."""
    return quality.keep_quality(docs, quality.fit_quality(docs))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts stays, the one with the largest doc_id (null ids are the smallest).  Empty texts
    are a group like any other; of repeated rows one stays."""
    return dedup_exact.exact_dedup(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of linked fingerprints stays.  Empty texts share fingerprint 0
    and link like any other; rows without an id stay; rows with one id stay or go together."""
    return simhash.near_dedup(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per copy of a document that the mix takes.  Documents without words weigh nothing and come along with their
    block; repeated rows are documents of their own; a null source is a source."""
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset.  An empty text is
    its end token; repeated rows are documents of their own."""
    packed = packing.pack(docs)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id",
                         "offset")


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("simhash", simhash_stage),
          ("mixing", mixing_stage), ("packing", packing_stage)]

#: A trained scorer, hashed draws and packing are not SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of ``sf_dir``; intermediate tables are Parquet under the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, f"stage-{name}") + "/table"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

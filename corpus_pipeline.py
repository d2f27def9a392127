"""From documents to packed training sequences: quality rules, near duplicates, decontamination, personal data, packing.

Each stage takes all that the one before has kept and returns a table with the columns of documents; the last returns the
pieces of sequences. Null texts count as empty and fall to the quality rules; empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import decontaminate, minhash, packing, pii, quality
from emberlog.llm.scratch import ROW, dropped, numbered, saved

#: Near duplicates: words in a shingle, and percent of shared shingles.
SHINGLE_WORDS, PERCENT = 5, 80
#: Ids are broadcast to drop documents if they are at most so many; beyond that the documents are shuffled to them.
BROADCAST_IDS = 4_000_000
#: SQL can't express the stages (boosted trees, signatures, tokenizers).
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one of least id (null last), of rows that share that id the first. Rows are told apart by
    ids of their own, so rows that only share a doc_id, or have none, are documents like all others."""
    rows = numbered(docs)
    judged = minhash.near_duplicates(rows, key=ROW, k=SHINGLE_WORDS, percent=PERCENT)
    named = saved(judged.join(rows.select(ROW, "doc_id"), ROW).select(ROW, "component_id", "doc_id"))
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", ROW)).alias("first"))
    gone = saved(named.select(ROW).join(first.select(F.col(f"first.{ROW}").alias(ROW)), ROW, "left_anti"))
    dropped(named)
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return rows.join(gone, ROW, "left_anti").select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(docs, benchmark).select(*docs.columns)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full sequences: doc_id, start, length, ids, doc_tokens, sequence_id, offset."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("private_data", private_data),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's table is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs

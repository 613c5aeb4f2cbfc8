"""Corpus pipeline: classify, drop near copies, cut repeated passages, drop contaminated documents, encode.

Every stage takes (spark, docs, sf_dir) and works on the whole of what its predecessor kept. All stages but the
last return the columns of ``documents``. Nulls, empty and repeated texts follow the operators' own definitions;
documents are told apart by ``doc_id``. Rows without an id are scored, tested for contamination and encoded like all
others; they have no copies or repeats, and none of them is dropped for those. Rows that repeat an id and text stay as
often as they came.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmark.llm import bpe, decontaminate, near_dedup, quality, suffix_dedup
from kinmark.llm._common import arrow_limits, stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    arrow_limits(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, name="quality_score").where(F.col("quality_score") >= quality.THRESHOLD).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    arrow_limits(spark)
    stays = near_dedup.near_components(docs, "doc_id", "text").where("kept").select(F.col("doc_id").alias("stays"))
    return docs.join(stays, docs["doc_id"].eqNullSafe(stays["stays"]), "left_semi").select(*COLUMNS)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings that occurred earlier are cut out; characters that a cut splits go with it."""
    left = suffix_dedup.cut_repeats(docs, "doc_id", "text", with_text=True).select("doc_id", F.col("kept_text").alias("text"))
    rest = docs.select(F.col("doc_id").alias("of"), "lang", "source").dropDuplicates(["of"])
    out = left.join(rest, left["doc_id"].eqNullSafe(rest["of"]))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark contaminates go. Rows are told apart by id and text, as ids may be null."""
    key = F.struct("doc_id", F.xxhash64("text")).alias("key")
    marks = decontaminate.contamination(docs.select(key, "text"), table(spark, sf_dir, "benchmark"), id_col="key")
    goes = marks.where("contaminated").select(F.col("key.doc_id").alias("i"), F.col("key.col2").alias("h")).distinct()
    return docs.join(goes, docs["doc_id"].eqNullSafe(goes["i"]) & (F.xxhash64(docs["text"]) == goes["h"]), "left_anti").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, and digests of ids and decoded texts."""
    arrow_limits(spark)
    vocab = public_tokenizers.path("word_bpe_49k.json")
    return bpe.encode_texts(docs, "doc_id", "text", vocab, digests_only=True)


STAGES = [("quality_classifier", classify), ("near_dedup", drop_near_copies), ("suffix_dedup", cut_passages), ("decontaminate", drop_contaminated), ("bpe", encode)]
#: A trained classifier has no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language_id, line_dedup, maxent_lm, mixing, ngram_join, permutation_index, token_counts, toxicity, warc
from .common import held_out, read


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id"), 4, 2))
    model = language_id.train(docs.where("not held_out").select("text", "lang"))
    return language_id.identify(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id"), 3, 1))
    model = toxicity.train(toxicity.sampled(docs.where("not held_out"), read(spark, sf_dir, "labels")))
    return toxicity.score(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.line_dedup(docs, count="lines_removed")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_classes(read(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"))


def op7_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.nearest(read(spark, sf_dir, "embeddings"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op9_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id"), 10, 0))
    return maxent_lm.train_and_score(docs.select("doc_id", "held_out", "text"), "held_out")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_decontaminate,
        op3_toxicity,
        op4_line_dedup,
        op5_ngram_join,
        op6_token_counts,
        op7_permutation_index,
        op8_mixing,
        op9_maxent_lm,
        op10_warc,
    )
}
ORACLES = {
    "op5_ngram_join": ngram_join.SQL.format(documents="documents"),
    "op8_mixing": mixing.SQL.format(documents="documents"),
    "op10_warc": warc.SQL.format(pages="pages"),
}

"""The corpus pipeline: each stage works on what the one before it kept.

language ID (rejected documents go), line dedup (documents left without words go), n-gram Jaccard join
(the document with the least doc_id of each group stays), benchmark decontamination (documents that
overlap an item go), mixing to target weights (documents of which the mix takes no word go).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, language_id, line_dedup, mixing, ngram_join
from tidemark.llm.common import cut, read


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no known language; the models learn from a bounded sample of labelled rows.

    Null and empty texts and those without letters go. Copies are decided alike, repeated rows each for
    themselves; all columns stay as they are, whatever their names. An empty table gives an empty one.
    """
    return language_id.identify(docs, language_id.train(docs), only_accepted=True)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes repeated runs of lines, and documents that lose all their words; n_chars follows the text.

    Of equal runs that of the least doc_id stays (null is least; ties by the text's hash, then the place).
    Null and empty texts stay as they are, and rows alike in id and text count as one document. Columns whose
    names begin with "__" are dropped, others stay. An empty table gives an empty one.
    """
    out = line_dedup.line_dedup(docs, drop_emptied=True)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def dedup_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: that with the least doc_id (null is largest).

    Ties go by the text's hash; of rows alike in id and text one stays. Texts without words all stay. All
    columns stay as they are. An empty table gives an empty one.
    """
    return ngram_join.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that overlap a benchmark item; what `decontaminate` says of nulls, ties, repeated rows
    and columns holds. Without documents or items nothing changes."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds what the mix takes of each document, and drops those of which it takes nothing, such as null and
    empty texts; what `mix_sources` says of ties, repeated rows and columns holds."""
    return mixing.mix_sources(docs).where("taken > 0")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_join", dedup_similar),
    ("decontaminate", remove_benchmark),
    ("mixing", mix),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

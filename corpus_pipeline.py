"""From raw documents to a training mix: five stages over the documents table, each written as Parquet before the next.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept.
All but the last return the columns of documents; the last returns the mix, one row for each
document that is left and how many of its words the mix takes.

In every stage a null in any column, an empty or very long text, ties, repeated rows and an empty
table have a defined result, stated there; columns that tables have besides stay as they are,
whatever their names, until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, table
from tidemark.llm.decontamination import decontaminate
from tidemark.llm.language_id import keep_identified
from tidemark.llm.line_dedup import keep_first_passages
from tidemark.llm.mixing import mix_sources
from tidemark.llm.near_dedup import near_duplicates


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without letters, or unlike all labelled writing, go.

    Null and empty texts have no letters and go; null ids, languages and sources are evidence of
    no kind; a text of any length is read whole; ties go to the language first by name; repeated
    rows are judged alike; with no labelled row, and in an empty table, all rows stay.
    """
    return keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; those that consist of such passages alone go.

    Null and empty texts stay; null ids come first in order; of different texts under one id the
    one with the smaller hash comes first; rows that repeat both are one document and are cut
    alike; a passage that a text repeats within itself stays once; an empty table stays empty.
    """
    return keep_first_passages(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; rows with a null id stay.

    Null and empty texts are like no other and stay; rows that repeat an id stay or go together;
    a text of any length is compared whole; an empty table stays empty.
    """
    judged = near_duplicates(docs).groupBy("doc_id").agg(F.max("kept").alias("kept"))
    gone = materialise(judged.where(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id"), "near-copies")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth, or nothing, stands in the benchmark's phrases.

    Null and empty texts have no words and stay; null ids don't matter; a share of exactly a
    twentieth goes; repeated rows are judged each, and alike; an empty table or benchmark changes nothing.
    """
    text = F.col("text").cast("string")
    digest = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("second"), text).alias("b")).alias("_digest")
    found = decontaminate(docs.select("text", digest), table(spark, sf_dir, "benchmark"), keep=["_digest"])
    # What a text comes to follows from the text alone, so that only texts go through the search, and digests of those that go come back.
    gone = materialise(found.where("contaminated").select("_digest").distinct(), "contaminated")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), digest)
    return rows.join(gone, "_digest", "left_anti").select("_row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target and taken: the words that the mix takes of each document.

    Null and empty texts have size 0 and give nothing; a null source is one of its own, last in
    order; equal quotients go to the source first in order; repeated rows and null ids count as
    rows of their own; an empty table gives no rows; other columns are not read.
    """
    return mix_sources(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: SQL has no form of the language stage's text model; tests/llm/test_pipeline.py holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""A corpus pipeline over ``documents``: each stage's rows are written as Parquet and read by the next.

Toxic documents go; lines that repeat anywhere go but for their first place, and documents that are left
without any; of near-duplicate documents the one with the smallest id stays; the sources are mixed to their target weights, in pieces of
documents; the mix is encoded into subword ids.

Every stage takes rows with null ids and texts, repeated ids, repeated rows, long texts and empty tables: null and
empty texts are clean and keep no line and no shingle, so they stay until the mix, which gives no piece of
them; rows with null ids stay whole up to there and are mixed like others; rows that repeat an id are
documents of their own, of which all stay where that id is kept. An empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termscan.llm import jaccard_join, line_dedup, mixing, subwords, toxicity
from termscan.llm.common import release, written
from termscan.session import shared_folder

#: Words of a block of the mix: most documents lie in a few blocks.
BLOCK_WORDS = 256


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier does not reject; it learns from the rows that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.train(docs, labels, ~toxicity.held_out(F.col("doc_id"))))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the lines of its text that stand here first; one that had words and keeps none goes."""
    written = lambda: F.regexp_like(F.coalesce("text", F.lit("")), F.lit(r"\S"))
    rows = line_dedup.dedup(docs.withColumn("__written", written()))
    rows = rows.where(~F.col("__written") | written())
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest id."""
    return jaccard_join.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents that the mix takes, as often as it takes them, under the documents' ids."""
    return mixing.mix(docs, BLOCK_WORDS).select(*docs.columns)


def subword_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The subword ids of each piece."""
    return subwords.encode(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("jaccard_join", jaccard_stage),
    ("mixing", mixing_stage),
    ("subwords", subword_stage),
]

#: Scores, signatures and draws by hash have no form in SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what each leaves is a table in the shared folder, its tables on the way are deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/termscan/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        before = written()
        stage(spark, docs, sf_dir).write.parquet(path)
        release(before)  # nothing that others have written
        docs = spark.read.parquet(path)
    return docs

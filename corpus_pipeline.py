"""A corpus pipeline: each stage works on what the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
read again as the next stage's docs.  All but the last return the columns of documents.

In every stage a null text counts as an empty one, texts of any length are read whole, rows
that occur more than once are judged one by one (near-dedup leaves one of them), an empty
table stays empty, and columns beside doc_id, text, source and n_chars may have any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guardloom.llm.common import materialise, release, table
from guardloom.llm.mixing import mix
from guardloom.llm.packing import pack
from guardloom.llm.quality import KEEP_FROM, fit_quality, quality_column
from guardloom.llm.shingles import keep_one_similar
from guardloom.llm.toxicity import PREDICT_FROM, fit_toxicity, toxicity_column


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that reach the highest grade with probability KEEP_FROM or more.

    The model is fitted on labelled rows of ``docs``; without any, every document stays."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality_column(model, F.col("text"))["p_tail"] >= KEEP_FROM)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic; without labels of both kinds, all of them
    or, if every label says toxic, none."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity_column(model, F.col("text")) < PREDICT_FROM)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more.
    Candidates come from SimHash, as in op7, and from MinHash for pairs beyond its radius.
    Documents without words are copies of each other.  The smallest doc_id stays."""
    return keep_one_similar(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources in their target proportions; a document can come twice, and what has no words
    has no part.  Documents without a source are one source."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; a document without a doc_id has pieces without one."""
    return pack(docs)


STAGES = [
    ("quality", quality),
    ("toxicity", toxicity),
    ("simhash near-dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL cannot express the models, the fingerprints' components or the tokenizer over whole tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; every stage but the last is written and reread."""
    docs = source = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), "pipeline")
        if before is not source:
            release(before)
    return STAGES[-1][1](spark, docs, sf_dir)

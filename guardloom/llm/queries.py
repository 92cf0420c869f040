"""The queries of this folder and the SQL that some can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guardloom.llm.ann import nearest
from guardloom.llm.chat import format_chats
from guardloom.llm.common import table
from guardloom.llm.counting import count_and_edit
from guardloom.llm.html_text import extract
from guardloom.llm.mixing import plan_mix
from guardloom.llm.oracle import SQL
from guardloom.llm.packing import pack
from guardloom.llm.quality import fit_quality, score_quality
from guardloom.llm.simhash import near_duplicates
from guardloom.llm.topk import exact_top_k
from guardloom.llm.toxicity import fit_toxicity, score_toxicity

Query = Callable[[SparkSession, str], DataFrame]


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False).drop("ids")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts after two edits to each document: an insertion at a place that its id
    gives, then a replacement of up to nine characters at another."""
    docs = table(spark, sf_dir, "documents")
    place = [F.pmod(F.xxhash64("doc_id", F.lit(i)), F.length("text") + 1).cast("int") for i in (1, 2)]
    spans = ((place[0], F.lit(0), F.lit(" inserted, it's new")), (place[1], F.lit(9), F.lit("re ")))
    edits = F.array(*[F.struct(a.alias("start"), n.alias("length"), w.alias("new")) for a, n, w in spans])
    return count_and_edit(docs, edits).select("doc_id", "n_tokens", "n_pretokens", "encoded_chars")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Query]:
    found = (op1_topk, op2_mix, op3_chat, op4_pack, op5_tokens, op6_toxicity, op7_simhash, op8_ann, op9_quality, op10_html)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

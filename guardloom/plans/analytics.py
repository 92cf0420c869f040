"""Queries over what the checks found: roll-ups, rankings, agreement with labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from guardloom.operators import inbound
from guardloom.plans import sql
from guardloom.plans.fixtures import INBOUND_PAYLOADS, with_payload
from guardloom.sources.readers import read_table, spread

_ROWS = sql.payload_rows("documents", "doc_id", INBOUND_PAYLOADS)


def _checked(spark, d):
    docs = spread(read_table(spark, d, "documents").select("doc_id", "text"))
    return inbound.check_inbound(with_payload(docs, "doc_id", INBOUND_PAYLOADS))


def threat_rollup(spark, d):
    return _checked(spark, d).rollup("surface", "threat_level").agg(F.count("*").alias("n"), F.max("risk_score").alias("most"))


def top_rules(spark, d):
    counts = _checked(spark, d).select(F.explode("matched_rules").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "rule"))).where("place <= 10")


def top_rules_by_surface(spark, d):
    counts = _checked(spark, d).select("surface", F.explode("matched_rules").alias("rule")).groupBy("surface", "rule").agg(F.count("*").alias("n"))
    line = Window.partitionBy("surface").orderBy(F.desc("n"), "rule")
    return counts.withColumn("place", F.row_number().over(line)).where("place <= 3")


def rule_cooccurrence(spark, d):
    distinct = F.array_sort(F.array_distinct("matched_rules"))
    pairs = F.flatten(F.transform(distinct, lambda a: F.transform(F.filter(distinct, lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    found = _checked(spark, d).select(F.explode(pairs).alias("p"))
    return found.groupBy(F.col("p.a").alias("rule_a"), F.col("p.b").alias("rule_b")).agg(F.count("*").alias("n"))


def label_agreement(spark, d):
    labels = spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("id"), "toxic")
    joined = _checked(spark, d).select("id", "is_safe").join(labels, "id")
    return joined.groupBy("toxic", "is_safe").agg(F.count("*").alias("n"))


def unsafe_documents(spark, d):
    """Documents with a label that the check does not pass: a semi-join, for training filters."""
    labels = spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("id"))
    return _checked(spark, d).where(~F.col("is_safe")).select("id", "threat_level").join(labels, "id", "left_semi")


_C = sql.inbound(_ROWS)
_LABELS = f"SELECT id, unnest(labels) AS rule, surface FROM ({_C})"
SQL = {
    "threat_rollup": f"SELECT surface, threat_level, count(*) AS n, max(risk_score) AS most FROM ({_C}) GROUP BY ROLLUP (surface, threat_level)",
    "top_rules": f"SELECT * FROM (SELECT rule, n, row_number() OVER (ORDER BY n DESC, rule)::INTEGER AS place FROM (SELECT rule, count(*) AS n FROM ({_LABELS}) GROUP BY rule)) WHERE place <= 10",
    "top_rules_by_surface": f"SELECT * FROM (SELECT surface, rule, n, row_number() OVER (PARTITION BY surface ORDER BY n DESC, rule)::INTEGER AS place FROM (SELECT surface, rule, count(*) AS n FROM ({_LABELS}) GROUP BY surface, rule)) WHERE place <= 3",
    "rule_cooccurrence": f"WITH r AS (SELECT DISTINCT id, rule FROM ({_LABELS})) SELECT a.rule AS rule_a, b.rule AS rule_b, count(*) AS n FROM r a JOIN r b ON a.id = b.id AND a.rule < b.rule GROUP BY ALL",
    "label_agreement": f"SELECT toxic, is_safe, count(*) AS n FROM ({_C}) c JOIN labels l ON c.id = l.doc_id GROUP BY ALL",
    "unsafe_documents": f"SELECT id, threat_level FROM ({_C}) WHERE NOT is_safe AND id IN (SELECT doc_id FROM labels)",
}


def queries():
    return {f.__name__: f for f in (threat_rollup, top_rules, top_rules_by_surface, rule_cooccurrence, label_agreement, unsafe_documents)}


def oracle_sql():
    return dict(SQL)

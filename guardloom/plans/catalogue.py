"""All queries over the driver's tables, with the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guardloom.functions import scoring as S
from guardloom.functions.rules import CREDENTIALS, INBOUND, PERSONAL, categories
from guardloom.operators import inbound, judge, outbound
from guardloom.operators.outbound import PrivacyConfig
from guardloom.plans import analytics, sql, tool_queries
from guardloom.plans.fixtures import INBOUND_PAYLOADS, NAMES, OUTBOUND_PAYLOADS, REPLIES, REWRITES, pick, with_payload
from guardloom.sources.readers import read_table, spread
from guardloom.streaming import queries as streams

Query = Callable[[SparkSession, str], DataFrame]

RAW_DOCS = "SELECT doc_id AS id, text, 'public' AS surface FROM documents"
IN_DOCS = sql.payload_rows("documents", "doc_id", INBOUND_PAYLOADS)
OUT_DOCS = sql.payload_rows("documents", "doc_id", OUTBOUND_PAYLOADS)
PAGES = "SELECT page_id AS id, html AS text, 'web-page' AS surface FROM pages"
TURN_KEY = "(conv_id * 1000000 + turn)"
IN_TURNS = sql.payload_rows(f"(SELECT {TURN_KEY} AS id, text FROM conversations WHERE role = 'user')", "id", INBOUND_PAYLOADS)
OUT_TURNS = sql.payload_rows(f"(SELECT {TURN_KEY} AS id, text FROM conversations WHERE role = 'assistant')", "id", OUTBOUND_PAYLOADS)
ENTROPY = PrivacyConfig(check_high_entropy=True, categories=())
NAMED = PrivacyConfig(protected_names=NAMES)
NARROW = ("financial", "health")
DISABLED = ("CRED_007", "CRED_002")
#: Findings of scans that are no single rule.
OTHER_FINDINGS = ("homoglyphs", "NLP-HEADING-LINE", "NLP-AUTHORITY", "NLP-HIDDEN", "high_entropy")


def texts(spark, d, name, key, *columns):
    """Columns of a table of texts, dealt out to all cores."""
    return spread(read_table(spark, d, name).select(key, *columns))


def raw_docs(spark, d):
    return texts(spark, d, "documents", "doc_id", "text").select(F.col("doc_id").alias("id"), "text", F.lit("public").alias("surface"))


def in_docs(spark, d):
    return with_payload(texts(spark, d, "documents", "doc_id", "text"), "doc_id", INBOUND_PAYLOADS)


def out_docs(spark, d):
    return with_payload(texts(spark, d, "documents", "doc_id", "text"), "doc_id", OUTBOUND_PAYLOADS)


def pages(spark, d):
    return texts(spark, d, "pages", "page_id", "html").select(F.col("page_id").alias("id"), F.col("html").alias("text"), F.lit("web-page").alias("surface"))


def turns(spark, d, role, payloads):
    rows = spread(read_table(spark, d, "conversations").where(F.col("role") == role).select("conv_id", "turn", "text"))
    return with_payload(rows.select((F.col("conv_id") * 1000000 + F.col("turn")).alias("key"), "text"), "key", payloads)


def joined(column: str):
    return F.array_join(column, ",")


def types_text():
    return joined("threat_types").alias("types")


def rules_text():
    return joined("matched_rules").alias("rules")


_Q: dict[str, tuple[Query, str | None]] = {}


def query(sql_text: str | None):
    def add(f: Query) -> Query:
        _Q[f.__name__] = (f, sql_text)
        return f

    return add


@query(f"SELECT threat_level, count(*) AS n, round(avg(risk_score), 6) AS mean_risk FROM ({sql.outbound(RAW_DOCS)}) GROUP BY 1")
def outbound_level_histogram(spark, d):
    checked = outbound.check_outbound(raw_docs(spark, d))
    return checked.groupBy("threat_level").agg(F.count("*").alias("n"), F.round(F.avg("risk_score"), 6).alias("mean_risk"))


@query(f"SELECT id, rules, types FROM ({sql.outbound(RAW_DOCS, credentials=False)})")
def outbound_pii_flags(spark, d):
    return outbound.check_outbound(raw_docs(spark, d), config=PrivacyConfig(check_credentials=False)).select("id", rules_text(), types_text())


@query(f"SELECT id, rules, types, risk_score FROM ({sql.outbound(OUT_DOCS, categories=())})")
def outbound_credential_flags(spark, d):
    return outbound.check_outbound(out_docs(spark, d), config=PrivacyConfig(categories=())).select("id", rules_text(), types_text(), "risk_score")


@query(f"SELECT id, rules, threat_level FROM ({sql.outbound(OUT_DOCS, disabled=DISABLED)})")
def outbound_disabled_rules(spark, d):
    return outbound.check_outbound(out_docs(spark, d), config=PrivacyConfig(disabled_rules=DISABLED)).select("id", rules_text(), "threat_level")


@query(f"SELECT id, rules, risk_score FROM ({sql.outbound(OUT_DOCS, categories=NARROW)})")
def outbound_category_filter(spark, d):
    return outbound.check_outbound(out_docs(spark, d), config=PrivacyConfig(categories=NARROW)).select("id", rules_text(), "risk_score")


@query(f"SELECT id, rules, risk_score, threat_level FROM ({sql.outbound(OUT_TURNS, names=NAMES)})")
def outbound_protected_names(spark, d):
    checked = outbound.check_outbound(turns(spark, d, "assistant", OUTBOUND_PAYLOADS), config=NAMED)
    return checked.select("id", rules_text(), "risk_score", "threat_level")


@query(
    f"""SELECT surface, CASE WHEN raw_score < 0.45e0 THEN 'SAFE' WHEN raw_score >= 0.9e0 THEN 'BLOCK' ELSE 'WARN' END AS status,
        count(*) AS n, sum(CASE WHEN is_safe THEN 1 ELSE 0 END)::BIGINT AS safe FROM ({sql.outbound(OUT_DOCS)}) GROUP BY ALL"""
)
def outbound_status_by_surface(spark, d):
    checked = outbound.check_outbound(out_docs(spark, d))
    word = S.status(F.col("threat_level"), S.OUTBOUND_WORDS).alias("status")
    return checked.groupBy("surface", word).agg(F.count("*").alias("n"), F.sum(F.col("is_safe").cast("long")).alias("safe"))


@query(f"SELECT id, {sql.redacted(names=NAMES)} AS redacted FROM ({OUT_DOCS})")
def outbound_redact(spark, d):
    return out_docs(spark, d).select("id", outbound.redact(F.col("text"), NAMED).alias("redacted"))


@query(f"SELECT id, threat_level, sanitized FROM ({sql.sanitized(OUT_DOCS, names=NAMES)})")
def outbound_sanitize(spark, d):
    return outbound.sanitize(out_docs(spark, d), config=NAMED).select("id", "threat_level", "sanitized")


@query(f"SELECT id, len({sql.entropy_runs()})::INTEGER AS runs, coalesce(list_max(list_transform({sql.entropy_runs()}, lambda r: length(r))), 0)::INTEGER AS longest FROM ({OUT_DOCS})")
def outbound_high_entropy(spark, d):
    rows = out_docs(spark, d).withColumn("found", S.once(outbound.high_entropy_runs(F.col("text"))))
    longest = F.coalesce(F.array_max(F.transform("found", F.length)), F.lit(0))
    return rows.select("id", F.size("found").alias("runs"), longest.alias("longest"))


@query(f"SELECT id, rules, risk_score FROM ({sql.outbound(OUT_DOCS, categories=(), entropy=True)})")
def outbound_entropy_check(spark, d):
    return outbound.check_outbound(out_docs(spark, d), config=ENTROPY).select("id", rules_text(), "risk_score")


@query(f"SELECT id, f.label AS rule, f.type AS type, f.score AS score FROM (SELECT id, unnest(findings) AS f FROM ({sql.inbound(IN_DOCS)}))")
def inbound_rule_hits(spark, d):
    checked = inbound.check_inbound(in_docs(spark, d)).select("id", F.explode("findings").alias("f"))
    return checked.select("id", F.col("f.label").alias("rule"), F.col("f.type").alias("type"), F.col("f.score").alias("score"))


@query(f"SELECT id, threat_level, raw_score, risk_score, blocked, is_safe, types, rules FROM ({sql.inbound(IN_DOCS)})")
def inbound_check(spark, d):
    checked = inbound.check_inbound(in_docs(spark, d))
    return checked.select("id", "threat_level", "raw_score", "risk_score", "blocked", "is_safe", types_text(), rules_text())


@query(f"SELECT id, threat_level, risk_score, rules FROM ({sql.inbound(PAGES)})")
def inbound_check_pages(spark, d):
    return inbound.check_inbound(pages(spark, d)).select("id", "threat_level", "risk_score", rules_text())


@query(f"SELECT id, round({sql.homoglyph()}, 9) AS score FROM ({IN_DOCS})")
def inbound_homoglyph(spark, d):
    return in_docs(spark, d).select("id", F.round(inbound.homoglyph_score(F.col("text")), 9).alias("score"))


@query(
    f"""SELECT r.id, coalesce(array_to_string(list_transform(l.found, lambda x: x.label), ','), '') AS found,
        coalesce(list_max(list_transform(l.found, lambda x: x.score)), 0e0) AS score FROM ({IN_DOCS}) r LEFT JOIN ({sql.lines_cte(IN_DOCS)}) l USING (id)"""
)
def inbound_markdown_scan(spark, d):
    rows = in_docs(spark, d).withColumn("f", S.once(inbound.markdown_findings(F.col("text"))))
    labels = F.array_join(F.transform("f", lambda x: x["label"]), ",")
    return rows.select("id", labels.alias("found"), S.raw_score(F.col("f")).alias("score"))


@query(f"SELECT id, CASE threat_level WHEN 'clean' THEN 'SAFE' WHEN 'low' THEN 'LOW' WHEN 'medium' THEN 'MEDIUM' ELSE 'HIGH' END AS status, risk_score, blocked FROM ({sql.inbound(IN_TURNS)})")
def inbound_status_dict(spark, d):
    checked = inbound.check_inbound(turns(spark, d, "user", INBOUND_PAYLOADS))
    return checked.select("id", S.status(F.col("threat_level"), S.INBOUND_WORDS).alias("status"), "risk_score", "blocked")


@query(f"SELECT id, CASE threat_level WHEN 'clean' THEN 'LOW' WHEN 'low' THEN 'LOW' WHEN 'medium' THEN 'MEDIUM' ELSE 'HIGH' END AS status, rules FROM ({sql.inbound(IN_TURNS)})")
def inbound_status_tuple(spark, d):
    checked = inbound.check_inbound(turns(spark, d, "user", INBOUND_PAYLOADS))
    return checked.select("id", S.status(F.col("threat_level"), S.INBOUND_SHORT).alias("status"), rules_text())


@query(f"SELECT id, CASE WHEN is_safe THEN 'SAFE' WHEN blocked THEN 'BLOCK' ELSE 'WARN' END AS status, CASE WHEN NOT is_safe THEN sanitized END AS redacted, risk_score FROM ({sql.sanitized(OUT_TURNS)})")
def outbound_status_dict(spark, d):
    out = outbound.sanitize(turns(spark, d, "assistant", OUTBOUND_PAYLOADS))
    word = S.status(F.col("threat_level"), S.OUTBOUND_WORDS).alias("status")
    return out.select("id", word, F.when(~F.col("is_safe"), F.col("sanitized")).alias("redacted"), "risk_score")


@query(f"SELECT id, CASE WHEN is_safe THEN 'SAFE' WHEN blocked THEN 'BLOCK' ELSE 'WARN' END AS status, CASE WHEN is_safe THEN text ELSE sanitized END AS text, rules FROM ({sql.sanitized(OUT_TURNS)})")
def outbound_status_tuple(spark, d):
    out = outbound.sanitize(turns(spark, d, "assistant", OUTBOUND_PAYLOADS))
    return out.select("id", S.status(F.col("threat_level"), S.OUTBOUND_WORDS).alias("status"), F.col("sanitized").alias("text"), rules_text())


@query(f"SELECT id, explanation FROM ({sql.outbound(OUT_DOCS)})")
def outbound_explanation(spark, d):
    return outbound.check_outbound(out_docs(spark, d)).select("id", "explanation")


@query(f"SELECT id, explanation FROM ({sql.inbound(IN_DOCS)})")
def inbound_explanation(spark, d):
    return inbound.check_inbound(in_docs(spark, d)).select("id", "explanation")


@query(f"SELECT id, risk_score FROM ({sql.inbound(IN_DOCS)}) WHERE NOT blank AND risk_score >= 0.35e0 AND risk_score < 0.9e0")
def judge_escalation_set(spark, d):
    return inbound.check_inbound(in_docs(spark, d)).where("needs_judge").select("id", "risk_score")


_VERDICTS = "SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 'high' WHEN quality = 0 THEN 'odd' ELSE 'clean' END AS j_level, CASE WHEN toxic = 1 THEN 0.8e0 WHEN quality = 0 THEN 0.5e0 ELSE 0.1e0 END AS j_score FROM labels"


@query(
    f"""SELECT id, CASE WHEN used THEN CASE j_level WHEN 'odd' THEN 'medium' ELSE j_level END ELSE threat_level END AS threat_level,
        CASE WHEN used THEN j_score ELSE risk_score END AS risk_score, used AS judge_used
        FROM (SELECT *, NOT blank AND risk_score >= 0.35e0 AND risk_score < 0.9e0 AND j_score IS NOT NULL AS used FROM ({sql.inbound(IN_DOCS)}) LEFT JOIN ({_VERDICTS}) USING (id))"""
)
def judge_merge(spark, d):
    toxic, poor = F.col("toxic") == 1, F.col("quality") == 0
    verdicts = read_table(spark, d, "labels").select(
        F.col("doc_id").alias("id"),
        F.when(toxic, "high").when(poor, "odd").otherwise("clean").alias("j_level"),
        F.when(toxic, 0.8).when(poor, 0.5).otherwise(0.1).alias("j_score"),
        F.array(F.lit("social_engineering")).alias("j_types"),
    )
    merged = judge.merge(inbound.check_inbound(in_docs(spark, d)), verdicts, "id")
    return merged.select("id", "threat_level", "risk_score", "judge_used")


_REPLY_SQL = "(" + "[" + ", ".join("NULL" if r is None else sql.q(r) for r in REPLIES) + "]" + f")[(id % {len(REPLIES)}) + 1]"
_REWRITE_SQL = "(" + "[" + ", ".join("NULL" if r is None else sql.q(r) for r in REWRITES) + "]" + f")[(id % {len(REWRITES)}) + 1]"


def _judged_sql(checked: str, least: float, types: str) -> str:
    return f"""SELECT id, CASE WHEN used THEN CASE WHEN told->>'$.threat_level' IN ('clean', 'low', 'medium', 'high', 'blocked') THEN told->>'$.threat_level' ELSE 'medium' END ELSE threat_level END AS threat_level,
        CASE WHEN used AND json_exists(told, '$.risk_score') THEN round_even((told->>'$.risk_score')::DOUBLE, 3) ELSE risk_score END AS risk_score, used AS judge_used,
        CASE WHEN used AND json_exists(told, '$.explanation') THEN told->>'$.explanation' ELSE explanation END AS explanation, {types} AS types
      FROM (SELECT *, NOT blank AND risk_score >= {least}e0 AND risk_score < 0.9e0 AND told IS NOT NULL AND coalesce(json_type(told->'$.risk_score'), 'DOUBLE') = 'DOUBLE' AS used
            FROM (SELECT *, CASE WHEN json_valid(bare) THEN bare::JSON END AS told FROM (SELECT *, regexp_replace(regexp_replace({_REPLY_SQL}, '^```json', ''), '```$', '') AS bare FROM ({checked}))))"""


@query(_judged_sql(sql.inbound(IN_DOCS), 0.35, "array_to_string(list_sort(list_distinct(list_concat(string_split(types, ',')[1:CASE WHEN types = '' THEN 0 ELSE 99 END], CASE WHEN used AND (id % 7) = 0 THEN ['social_engineering'] ELSE [] END))), ',')"))
def judge_replies(spark, d):
    """Verdicts read from a judge's replies, over texts that came in."""
    checked = inbound.check_inbound(in_docs(spark, d))
    told = checked.where("needs_judge").select("id", pick(REPLIES, F.col("id")).alias("reply"))
    return judge.merge(checked, judge.read_verdicts(told, "id"), "id").select("id", "threat_level", "risk_score", "judge_used", "explanation", types_text())


@query(_judged_sql(sql.outbound(OUT_DOCS), 0.3, "types"))
def outbound_judge(spark, d):
    """The same over texts that go out: types are the check's."""
    checked = outbound.check_outbound(out_docs(spark, d))
    told = checked.where("needs_judge").select("id", pick(REPLIES, F.col("id")).alias("reply"))
    return judge.merge(checked, judge.read_verdicts(told, "id"), "id", types=False).select("id", "threat_level", "risk_score", "judge_used", "explanation", types_text())


@query(
    f"""SELECT id, threat_level, CASE WHEN is_safe THEN text WHEN blocked THEN {sql.q(outbound.BLOCKED_TEXT)} WHEN trim(said) = 'BLOCKED' THEN {sql.q(outbound.BLOCKED_TEXT)}
        WHEN trim(said) <> '' THEN trim(said) ELSE redacted END AS sanitized FROM (SELECT *, {_REWRITE_SQL} AS said FROM ({sql.sanitized(OUT_DOCS)}))"""
)
def outbound_rewrite(spark, d):
    """Texts that are neither safe nor blocked, rewritten by a judge where it has an answer."""
    out = outbound.sanitize(out_docs(spark, d))
    told = out.where(judge.needs_rewrite()).select("id", pick(REWRITES, F.col("id")).alias("rewrite"))
    return judge.rewritten(out, told, "id").select("id", "threat_level", "sanitized")


@query(
    f"""SELECT id, 'Result(level=' || threat_level || ', score=' || printf('%.3f', risk_score) || ', types=[' || CASE WHEN types = '' THEN 'none' ELSE replace(types, ',', ', ') END || '], surface=' || chr(39) || surface || chr(39) || ')' AS said,
        threat_level AS level, risk_score AS risk, is_safe, rules FROM ({sql.inbound(IN_DOCS)})"""
)
def result_texts(spark, d):
    """Results as a line of text and as JSON, read back."""
    checked = inbound.check_inbound(in_docs(spark, d))
    told = checked.select("id", S.result_text().alias("said"), S.result_json(checked.columns).alias("json"))
    read = F.from_json("json", "threat_level string, risk_score double, is_safe boolean, matched_rules array<string>")
    return told.select("id", "said", read["threat_level"].alias("level"), read["risk_score"].alias("risk"), read["is_safe"].alias("is_safe"), joined(read["matched_rules"]).alias("rules"))


_ALL_RULES = ", ".join(f"({sql.q(x)})" for x in (*(r.id for r in (*INBOUND, *PERSONAL, *CREDENTIALS)), *OTHER_FINDINGS))


@query(
    f"""SELECT r.rule, count(f.rule) AS n FROM (VALUES {_ALL_RULES}) AS r(rule) LEFT JOIN (
          SELECT unnest(labels) AS rule FROM ({sql.inbound(IN_DOCS)}) UNION ALL SELECT unnest(labels) FROM ({sql.outbound(OUT_DOCS, entropy=True)})) f ON f.rule = r.rule GROUP BY r.rule"""
)
def rule_coverage(spark, d):
    """How many findings each rule has over texts with payloads, in either direction."""
    came = inbound.check_inbound(in_docs(spark, d)).select(F.explode("matched_rules").alias("rule"))
    went = outbound.check_outbound(out_docs(spark, d), config=PrivacyConfig(check_high_entropy=True)).select(F.explode("matched_rules").alias("rule"))
    counts = came.union(went).groupBy("rule").agg(F.count("*").alias("n"))
    names = [(x,) for x in (*(r.id for r in (*INBOUND, *PERSONAL, *CREDENTIALS)), *OTHER_FINDINGS)]
    return spark.createDataFrame(names, "rule string").join(counts, "rule", "left").select("rule", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


_RULE_ROWS = ", ".join(f"({sql.q(r.id)}, {sql.q(r.type)}, {r.base}e0)" for r in (*INBOUND, *PERSONAL, *CREDENTIALS))


@query(f"SELECT type, count(*) AS rules, max(base) AS most, round(avg(base), 6) AS mean FROM (VALUES {_RULE_ROWS}) AS t(id, type, base) GROUP BY type")
def rule_catalogue(spark, d):
    rows = [(r.id, r.type, r.base) for r in (*INBOUND, *PERSONAL, *CREDENTIALS)]
    rules = spark.createDataFrame(rows, "id string, type string, base double")
    return rules.groupBy("type").agg(F.count("*").alias("rules"), F.max("base").alias("most"), F.round(F.avg("base"), 6).alias("mean"))


_OUT_CATEGORY = ", ".join(f"({sql.q(c)}, {sql.q(r.id)})" for r in PERSONAL for c in r.categories)


@query(
    f"""SELECT 'inbound' AS direction, type AS category, count(*) AS rules FROM (VALUES {", ".join(f"({sql.q(r.id)}, {sql.q(r.type)})" for r in INBOUND)}) AS t(id, type) GROUP BY ALL
        UNION ALL SELECT 'outbound', category, count(*) FROM (VALUES {_OUT_CATEGORY}) AS t(category, id) GROUP BY ALL
        UNION ALL SELECT 'outbound', {sql.q(CREDENTIALS[0].type)}, {len(CREDENTIALS)}"""
)
def category_catalogue(spark, d):
    rows = [(c["direction"], c["category"], c["count"]) for c in categories() if c["count"]]
    return spark.createDataFrame(rows, "direction string, category string, rules long")


def queries() -> dict[str, Query]:
    out = {name: f for name, (f, _) in _Q.items()}
    out |= tool_queries.queries() | analytics.queries()
    return out | {f.__name__: f for f in (streams.stream_toolcall_decide, streams.stream_taint)}


def oracle_sql() -> dict[str, str]:
    out = {name: text for name, (_, text) in _Q.items() if text is not None}
    return out | tool_queries.oracle_sql() | analytics.oracle_sql()


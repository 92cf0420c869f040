"""The inbound check: injection, obfuscation and social engineering in text that comes in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardloom.functions import scoring as S
from guardloom.functions.dialect import INBOUND_FLAGS, PLAIN_FLAGS, java
from guardloom.functions.literals import folded
from guardloom.functions.rules import INBOUND, INBOUND_FACTORS, KEYWORDS, LOOKALIKE_RANGES, TARGETS

JUDGE_FROM = 0.35


def homoglyph_score(text: Column) -> Column:
    """0 to 0.75 by how many letters are look-alikes and how many marks are combined."""
    alike = F.length(F.regexp_replace(text, f"[^{LOOKALIKE_RANGES}]", ""))
    marks = F.length(F.regexp_replace(text, r"\P{M}", ""))
    suspicious = alike + F.when(marks >= 5, F.floor(marks / 2)).otherwise(F.lit(0))
    ratio = suspicious / F.greatest(F.length(text), F.lit(1))
    some = F.when(suspicious < 3, F.lit(0.2)).when(ratio > 0.1, F.lit(0.75)).otherwise(F.least(ratio * 3 + 0.3, F.lit(0.85)))
    return F.when((alike == 0) & (marks < 5), F.lit(0.0)).otherwise(some)


def markdown_findings(text: Column) -> Column:
    """(label, type, score) of each line outside code fences that gives instructions.

    The line that opens a fence is inside it and the one that closes it is not.  Quoted
    lines never count; list items count like paragraphs.
    """
    keyword, target = java(KEYWORDS, PLAIN_FLAGS), java(TARGETS, PLAIN_FLAGS)
    empty = F.array().cast(S.FINDINGS)

    def step(state: Column, raw: Column) -> Column:
        line = F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")
        fenced = F.when(line.startswith("```"), ~state["fenced"]).otherwise(state["fenced"])
        score = (
            F.when(line.startswith("#"), F.lit(0.78))
            .when(line.startswith(">"), F.lit(None).cast("double"))
            .when(line.rlike(target), F.lit(0.72))
            .otherwise(F.lit(0.60))
        )
        name = F.when(score == 0.78, "NLP-HEADING-LINE").when(score == 0.72, "NLP-AUTHORITY").otherwise("NLP-HIDDEN")
        counts = ~fenced & line.rlike(keyword) & score.isNotNull()
        one = F.array(S.finding(name, "prompt_injection", score)).cast(S.FINDINGS)
        return F.struct(fenced.alias("fenced"), F.when(counts, F.concat(state["found"], one)).otherwise(state["found"]).alias("found"))

    start = F.struct(F.lit(False).alias("fenced"), empty.alias("found"))
    scan = F.aggregate(F.split(text, "\n"), start, step, lambda s: s["found"])
    return F.when(text.rlike(keyword), scan).otherwise(empty)


def check_inbound(
    df: DataFrame,
    text: str = "text",
    surface: str = "surface",
    homoglyphs: bool = True,
    markdown: bool = True,
    judge_from: float = JUDGE_FROM,
) -> DataFrame:
    """``df`` with the columns of the inbound check; ``text`` and ``surface`` name its columns.

    A blank or null text is clean.  An unknown or null surface has factor 1.  Filters that do
    not need the result belong before this: the matched rules are computed once per row.
    Columns of ``df`` stay, whatever their names, but for those that the result's own replace.
    """
    body, (low, once) = F.col(text), S.unused(df.columns, "_low", "_seen")
    seen_of = lambda name: F.col(f"{once}.{name}")
    factor = S.lookup(INBOUND_FACTORS, F.col(surface))
    parts = [S.findings_of(seen_of("hits"), INBOUND, factor)]
    if homoglyphs:
        score = seen_of("alike")
        alike = F.array(S.finding("homoglyphs", "unicode_bypass", score * factor)).cast(S.FINDINGS)
        parts.append(F.when(score > 0, alike).otherwise(F.array().cast(S.FINDINGS)))
    if markdown:
        scaled = lambda f: F.struct(f["label"].alias("label"), f["type"].alias("type"), F.least(f["score"] * factor, F.lit(1.0)).alias("score"))
        parts.append(F.transform(seen_of("lines"), scaled).cast(S.FINDINGS))
    blank = S.is_blank(body)
    none = F.array().cast("array<int>")
    seen = F.struct(
        blank.alias("blank"),
        F.when(blank, none).otherwise(S.hits(body, INBOUND, INBOUND_FLAGS, F.col(low))).alias("hits"),
        F.when(blank, F.lit(0.0)).otherwise(homoglyph_score(body)).alias("alike"),
        F.when(blank, F.array().cast(S.FINDINGS)).otherwise(markdown_findings(body)).alias("lines"),
    )
    found = df.withColumn(low, S.once(folded(body))).withColumn(once, S.once(seen)).withColumn("findings", F.concat(*parts))
    out = found.withColumns(S.judged(F.col("findings"), "Matched # pattern(s): ", "No threats detected", seen_of("blank")))
    risk = F.col("risk_score")
    return out.withColumn("needs_judge", ~seen_of("blank") & (risk >= judge_from) & (risk < 0.9)).drop(low, once)

"""Findings of a text and what follows from them: score, level, status, explanation.

A finding is a struct (label, type, score).  All columns here are plain expressions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from guardloom.functions.dialect import java
from guardloom.functions.literals import required_literals
from guardloom.functions.rules import Rule

FINDINGS = "array<struct<label:string,type:string,score:double>>"
# Least unrounded score of each level, and the levels' order.
LEVELS = (("blocked", 0.90), ("high", 0.70), ("medium", 0.45), ("low", 0.20), ("clean", None))
LEVEL_ORDER = ("clean", "low", "medium", "high", "blocked")


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(r"(?U)\S")


def lookup(table: Mapping[str, float], key: Column, default: float = 1.0) -> Column:
    """A number from a small table that is part of the plan."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def once(column: Column) -> Column:
    """Keeps a costly column from being copied into filters above it: the planner does not
    move a filter through a column that depends on where its row is, or merge such columns."""
    return F.when(F.spark_partition_id() >= 0, column)


def unused(columns: Sequence[str], *names: str) -> list[str]:
    """``names``, each with underscores before it until no column has it."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name in taken:
            name = "_" + name
        out.append(name)
    return out


def hits(text: Column, rules: Sequence[Rule], flags: str, low: Column | None = None) -> Column:
    """Places (from 1) of the rules that match, in order.

    With ``low``, the text folded to small letters, a pattern is only tried where one of the
    literals that it needs occurs; the result is the same.
    """
    found = []
    for i, r in enumerate(rules, 1):
        match, needed = text.rlike(java(r.pattern, flags)), required_literals(r.pattern)
        if low is not None and needed:
            match = reduce(or_, [low.contains(x) for x in sorted(needed)]) & match
        found.append(F.when(match, F.lit(i)))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<int>")


def findings_of(found: Column, rules: Sequence[Rule], factor: Column) -> Column:
    if not rules:
        return F.array().cast(FINDINGS)
    labels, types, bases = (F.array(*[F.lit(getattr(r, x)) for r in rules]) for x in ("id", "type", "base"))
    return F.transform(
        found,
        lambda i: F.struct(
            F.element_at(labels, i).alias("label"),
            F.element_at(types, i).alias("type"),
            F.least(F.element_at(bases, i) * factor, F.lit(1.0)).alias("score"),
        ),
    ).cast(FINDINGS)


def finding(label: Column | str, kind: str, score: Column) -> Column:
    label = F.lit(label) if isinstance(label, str) else label
    return F.struct(label.alias("label"), F.lit(kind).alias("type"), score.alias("score"))


def raw_score(findings: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(findings, lambda f: f["score"])), F.lit(0.0))


def level(raw: Column) -> Column:
    """By the unrounded score."""
    out = F.lit(LEVELS[-1][0])
    for name, least in reversed(LEVELS[:-1]):
        out = F.when(raw >= least, F.lit(name)).otherwise(out)
    return out


def level_order(name: Column) -> Column:
    return (F.array_position(F.array(*[F.lit(x) for x in LEVEL_ORDER]), name) - 1).cast("int")


def explanation(labels: Column, some: str, none: str) -> Column:
    n = F.size(labels)
    more = F.when(n > 3, F.concat(F.lit(" (+ "), (n - 3).cast("string"), F.lit(" more)"))).otherwise("")
    text = F.concat(F.lit(some.split("#")[0]), n.cast("string"), F.lit(some.split("#")[1]), F.array_join(F.slice(labels, 1, 3), "; "), more)
    return F.when(n > 0, text).otherwise(none)


#: Status words by level, for each of the two result styles.
INBOUND_WORDS = {"clean": "SAFE", "low": "LOW", "medium": "MEDIUM", "high": "HIGH", "blocked": "HIGH"}
INBOUND_SHORT = {"clean": "LOW", "low": "LOW", "medium": "MEDIUM", "high": "HIGH", "blocked": "HIGH"}
OUTBOUND_WORDS = {"clean": "SAFE", "low": "SAFE", "medium": "WARN", "high": "WARN", "blocked": "BLOCK"}


def status(name: Column, words: Mapping[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in words.items() for x in pair]), name)


def judged(findings: Column, some: str, none: str, blank: Column) -> dict[str, Column]:
    """Columns that follow from a column of findings, and from whether the text is blank."""
    raw, labels = raw_score(findings), F.transform(findings, lambda f: f["label"])
    name = level(raw)
    return {
        "raw_score": raw,
        "risk_score": F.bround(raw, 3),
        "threat_level": name,
        "level_ord": level_order(name),
        "threat_types": F.array_sort(F.array_distinct(F.transform(findings, lambda f: f["type"]))),
        "is_safe": raw < 0.45,
        "blocked": raw >= 0.90,
        "matched_rules": labels,
        "explanation": F.when(blank, "Empty input").otherwise(explanation(labels, some, none)),
    }


#: What a result says of itself, in order.
RESULT_KEYS = ("threat_level", "threat_types", "risk_score", "is_safe", "blocked", "explanation", "surface", "judge_used", "matched_rules")


def result_json(columns: Sequence[str]) -> Column:
    """A checked row as a JSON object: RESULT_KEYS, judge_used false where no judge was asked,
    and for tool calls what is known of their taint."""
    own = [F.lit(False).alias(k) if k == "judge_used" and k not in columns else F.col(k) for k in RESULT_KEYS]
    flow = ("tainted", "source", "sink", "path", "dangerous_flow")
    if set(flow) <= set(columns):
        own.append(F.when(F.col("tainted"), F.struct(*flow)).alias("taint"))
    return F.to_json(F.struct(*own))


def result_text() -> Column:
    """A checked row in one line, for logs."""
    types = F.when(F.size("threat_types") > 0, F.array_join("threat_types", ", ")).otherwise("none")
    return F.concat(
        F.lit("Result(level="), "threat_level", F.lit(", score="), F.format_string("%.3f", "risk_score"),
        F.lit(", types=["), types, F.lit("], surface='"), "surface", F.lit("')"),
    )

"""The outbound check: personal data, protected names and credentials in text that goes out."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardloom.functions import scoring as S
from guardloom.functions.dialect import OUTBOUND_FLAGS, PLAIN_FLAGS, java
from guardloom.functions.literals import folded
from guardloom.functions.rules import CATEGORIES, CREDENTIALS, OUTBOUND_FACTORS, PERSONAL, Rule

REDACTED = "[REDACTED]"
# Fixed value: what a text becomes of which nothing may go out.
BLOCKED_TEXT = "[BLOCKED — content contained only sensitive private information]"
JUDGE_FROM = 0.3
ENTROPY_RUN = r"[A-Za-z0-9+/=_\-]{40,}"
ENTROPY_BITS = 4.5


@dataclass(frozen=True)
class PrivacyConfig:
    """What the outbound check looks for."""

    protected_names: tuple[str, ...] = ()
    categories: tuple[str, ...] = CATEGORIES
    check_credentials: bool = True
    disabled_rules: tuple[str, ...] = ()
    check_high_entropy: bool = False
    judge_from: float = JUDGE_FROM

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(n for n in self.protected_names if n and n.strip())

    @property
    def personal(self) -> tuple[Rule, ...]:
        return tuple(r for r in PERSONAL if set(r.categories) & set(self.categories))

    @property
    def credentials(self) -> tuple[Rule, ...]:
        return tuple(r for r in CREDENTIALS if r.id not in self.disabled_rules) if self.check_credentials else ()


def name_pattern(name: str) -> str:
    return java(rf"\b{re.escape(name)}\b", PLAIN_FLAGS)


def entropy_bits(run: Column) -> Column:
    """Shannon entropy of a string in bits per character, summed in the order of its characters."""
    chars = F.split(run, "")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.size(chars)
    return F.aggregate(F.array_sort(F.array_distinct(chars)), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))


def high_entropy_runs(text: Column) -> Column:
    """Long runs of key-like characters whose entropy is that of a random key."""
    return F.filter(F.regexp_extract_all(text, F.lit(ENTROPY_RUN), F.lit(0)), lambda r: entropy_bits(r) >= ENTROPY_BITS)


def redact(text: Column, config: PrivacyConfig = PrivacyConfig()) -> Column:
    """Names first, then the rules that redact, each on what the one before left."""
    for name in config.names:
        text = F.regexp_replace(text, name_pattern(name), REDACTED)
    for rule in config.personal:
        if rule.redacts:
            text = F.regexp_replace(text, java(rule.pattern, OUTBOUND_FLAGS), REDACTED)
    return text


def redact_all(text: Column, config: PrivacyConfig = PrivacyConfig()) -> Column:
    """An extension: every personal-data and credential match goes, not only those above."""
    text = redact(text, config)
    for rule in (*config.personal, *config.credentials):
        text = F.regexp_replace(text, java(rule.pattern, OUTBOUND_FLAGS), REDACTED)
    return text


def check_outbound(df: DataFrame, text: str = "text", surface: str = "surface", config: PrivacyConfig = PrivacyConfig()) -> DataFrame:
    """``df`` with the columns of the outbound check; blank and null texts are clean.

    Columns of ``df`` stay, whatever their names, but for those that the result's own replace."""
    low, once = S.unused(df.columns, "_low", "_seen")
    seen_of = lambda name: F.col(f"{once}.{name}")
    body, factor = F.col(text), S.lookup(OUTBOUND_FACTORS, F.col(surface))
    none, blank = F.array().cast("array<int>"), S.is_blank(body)
    names = [F.when(body.rlike(name_pattern(n)), F.lit(i)) for i, n in enumerate(config.names, 1)]
    seen = F.struct(
        blank.alias("blank"),
        F.when(blank, none).otherwise(S.hits(body, config.personal, OUTBOUND_FLAGS, F.col(low))).alias("personal"),
        F.when(blank, none).otherwise(F.array_compact(F.array(*names)) if names else none).alias("names"),
        F.when(blank, none).otherwise(S.hits(body, config.credentials, OUTBOUND_FLAGS, F.col(low))).alias("credentials"),
        (F.when(blank, 0).otherwise(F.size(high_entropy_runs(body))) if config.check_high_entropy else F.lit(0)).alias("runs"),
    )
    scanned = df.withColumn(low, S.once(folded(body))).withColumn(once, S.once(seen))
    name_list = F.array(*[F.lit(n) for n in config.names]) if names else F.array().cast("array<string>")
    named = lambda i: S.finding(F.concat(F.lit("name:"), F.element_at(name_list, i)), "privacy_violation", F.least(factor * 0.72, F.lit(0.89)))
    random_run = S.finding("high_entropy", "credential_leak", F.lit(0.72))
    found = F.concat(
        S.findings_of(seen_of("personal"), config.personal, factor),
        F.transform(seen_of("names"), named).cast(S.FINDINGS),
        S.findings_of(seen_of("credentials"), config.credentials, F.greatest(factor, F.lit(1.0))),
        F.array_repeat(random_run, seen_of("runs")).cast(S.FINDINGS),
    )
    out = scanned.withColumn("findings", found)
    out = out.withColumns(S.judged(F.col("findings"), "Privacy risk in # area(s): ", "No privacy violations detected", seen_of("blank")))
    risk = F.col("risk_score")
    return out.withColumn("needs_judge", ~seen_of("blank") & (risk >= config.judge_from) & (risk < 0.9)).drop(low, once)


def sanitize(df: DataFrame, text: str = "text", surface: str = "surface", config: PrivacyConfig = PrivacyConfig()) -> DataFrame:
    """The outbound check with ``redacted`` and ``sanitized``, in one scan.

    Safe texts stay.  A blocked text that redaction does not change becomes a fixed message.
    """
    out = check_outbound(df, text, surface, config).withColumn("redacted", redact(F.col(text), config))
    only = F.col("blocked") & F.col("redacted").eqNullSafe(F.col(text))
    clean = F.when(F.col("is_safe"), F.col(text)).when(only, BLOCKED_TEXT).otherwise(F.col("redacted"))
    return out.withColumn("sanitized", clean)

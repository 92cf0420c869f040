"""DuckDB SQL of the checks, from the same registry; written on its own, not from Spark's plans."""

from __future__ import annotations

from collections.abc import Sequence

from guardloom.functions.dialect import INBOUND_FLAGS, OUTBOUND_FLAGS, PLAIN_FLAGS, re2
from guardloom.functions.rules import CATEGORIES, CREDENTIALS, INBOUND, INBOUND_FACTORS, KEYWORDS, LOOKALIKE_RANGES, OUTBOUND_FACTORS, PERSONAL, SURFACES, TARGETS
from guardloom.operators.outbound import BLOCKED_TEXT, ENTROPY_RUN


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values: Sequence[str]) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def chosen(values: Sequence[str], key: str) -> str:
    return f"({listed(values)})[({key} % {len(values)}) + 1]"


def payload_rows(table: str, key: str, payloads: Sequence[str], text: str = "text") -> str:
    return f"SELECT {key} AS id, {text} || chr(10) || {chosen(payloads, key)} AS text, {chosen(SURFACES, key)} AS surface FROM {table}"


def factor(table: dict, surface: str = "surface") -> str:
    return f"CASE {surface} " + " ".join(f"WHEN {q(k)} THEN {v}e0" for k, v in table.items()) + " ELSE 1e0 END"


def matches(pattern: str, flags: str, text: str = "text") -> str:
    return f"regexp_matches({text}, {q(re2(pattern, flags))})"


def hit_list(rules, flags: str, effective: str) -> str:
    """A list of findings; ``effective`` is the score with {base} put in."""
    items = []
    for r in rules:
        score = effective.format(base=f"{r.base}e0")
        items.append(f"CASE WHEN {matches(r.pattern, flags)} THEN {{'label': {q(r.id)}, 'type': {q(r.type)}, 'score': {score}}} END")
    return "list_filter([" + ",\n".join(items) + "], lambda x: x IS NOT NULL)" if items else EMPTY


EMPTY = "CAST([] AS STRUCT(label VARCHAR, type VARCHAR, score DOUBLE)[])"
LEVEL = "CASE WHEN raw_score >= 0.9e0 THEN 'blocked' WHEN raw_score >= 0.7e0 THEN 'high' WHEN raw_score >= 0.45e0 THEN 'medium' WHEN raw_score >= 0.2e0 THEN 'low' ELSE 'clean' END"


def judged(source: str, some: str, none: str) -> str:
    """Rows with findings -> the columns that follow, lists as text."""
    before, after = some.split("#")
    return f"""
      SELECT *, {LEVEL} AS threat_level,
        round_even(raw_score, 3) AS risk_score, raw_score >= 0.9e0 AS blocked, raw_score < 0.45e0 AS is_safe,
        array_to_string(list_sort(list_distinct(list_transform(findings, lambda f: f.type))), ',') AS types,
        array_to_string(labels, ',') AS rules,
        CASE WHEN blank THEN 'Empty input' WHEN len(labels) = 0 THEN {q(none)}
             ELSE {q(before)} || len(labels) || {q(after)} || array_to_string(labels[1:3], '; ') ||
                  CASE WHEN len(labels) > 3 THEN ' (+ ' || (len(labels) - 3) || ' more)' ELSE '' END END AS explanation
      FROM (SELECT *, coalesce(list_max(list_transform(findings, lambda f: f.score)), 0e0) AS raw_score,
                   list_transform(findings, lambda f: f.label) AS labels,
                   text IS NULL OR NOT regexp_matches(text, '\\S') AS blank FROM ({source}))"""


def homoglyph(text: str = "text") -> str:
    alike = f"length(regexp_replace({text}, '[^{LOOKALIKE_RANGES}]', '', 'g'))"
    marks = f"length(regexp_replace({text}, '\\P{{M}}', '', 'g'))"
    s = f"({alike} + CASE WHEN {marks} >= 5 THEN {marks} // 2 ELSE 0 END)"
    ratio = f"({s}::DOUBLE / greatest(length({text}), 1))"
    return f"CASE WHEN {alike} = 0 AND {marks} < 5 THEN 0e0 WHEN {s} < 3 THEN 0.2e0 WHEN {ratio} > 0.1e0 THEN 0.75e0 ELSE least({ratio} * 3e0 + 0.3e0, 0.85e0) END"


def lines_cte(rows: str) -> str:
    """id, findings of markdown lines, unscaled, in order."""
    key, target = q(re2(KEYWORDS, PLAIN_FLAGS)), q(f"(?i)(?:^|[^\\p{{L}}\\p{{N}}_])({TARGETS[3:-3]})(?:$|[^\\p{{L}}\\p{{N}}_])")
    return f"""
      SELECT id, list({{'label': label, 'type': 'prompt_injection', 'score': score}} ORDER BY n) AS found FROM (
        SELECT id, n, CASE WHEN starts_with(line, '#') THEN 0.78e0 WHEN regexp_matches(line, {target}) THEN 0.72e0 ELSE 0.6e0 END AS score,
               CASE WHEN starts_with(line, '#') THEN 'NLP-HEADING-LINE' WHEN regexp_matches(line, {target}) THEN 'NLP-AUTHORITY' ELSE 'NLP-HIDDEN' END AS label
        FROM (SELECT id, n, line, sum(CASE WHEN starts_with(line, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY n ROWS UNBOUNDED PRECEDING) AS fences
              FROM (SELECT id, u.n, regexp_replace(u.raw, '^[\\s\\x{{0B}}\\x{{85}}\\p{{Z}}]+|[\\s\\x{{0B}}\\x{{85}}\\p{{Z}}]+$', '', 'g') AS line
                    FROM ({rows}) r, unnest(string_split(r.text, chr(10))) WITH ORDINALITY AS u(raw, n)))
        WHERE fences % 2 = 0 AND NOT starts_with(line, '>') AND regexp_matches(line, {key}))
      GROUP BY id"""


def inbound(rows: str) -> str:
    f = factor(INBOUND_FACTORS)
    found = hit_list(INBOUND, INBOUND_FLAGS, "least({base} * factor, 1e0)")
    source = f"""
      SELECT b.id, b.text, b.surface, list_concat(list_concat({found},
             CASE WHEN alike > 0 THEN [{{'label': 'homoglyphs', 'type': 'unicode_bypass', 'score': alike * factor}}] ELSE {EMPTY} END),
             coalesce(list_transform(l.found, lambda x: {{'label': x.label, 'type': x.type, 'score': least(x.score * factor, 1e0)}}), {EMPTY})) AS findings, alike
      FROM (SELECT *, {f} AS factor, {homoglyph()} AS alike FROM ({rows})) b LEFT JOIN ({lines_cte(rows)}) l USING (id)"""
    return judged(source, "Matched # pattern(s): ", "No threats detected")


def edge_name(name: str) -> str:
    return rf"\b({name})\b"


def outbound(rows: str, names: Sequence[str] = (), categories: Sequence[str] = CATEGORIES, credentials: bool = True, disabled: Sequence[str] = (), entropy: bool = False) -> str:
    personal = [r for r in PERSONAL if set(r.categories) & set(categories)]
    secret = [r for r in CREDENTIALS if r.id not in disabled] if credentials else []
    parts = [hit_list(personal, OUTBOUND_FLAGS, "least({base} * factor, 1e0)")]
    if names := [n for n in names if n.strip()]:
        items = [f"CASE WHEN {matches(edge_name(n), PLAIN_FLAGS)} THEN {{'label': {q('name:' + n)}, 'type': 'privacy_violation', 'score': least(0.72e0 * factor, 0.89e0)}} END" for n in names]
        parts.append("list_filter([" + ", ".join(items) + "], lambda x: x IS NOT NULL)")
    parts.append(hit_list(secret, OUTBOUND_FLAGS, "least({base} * greatest(factor, 1e0), 1e0)"))
    if entropy:
        parts.append(f"list_transform({entropy_runs()}, lambda r: {{'label': 'high_entropy', 'type': 'credential_leak', 'score': 0.72e0}})")
    findings = parts[0]
    for p in parts[1:]:
        findings = f"list_concat({findings}, {p})"
    source = f"SELECT id, text, surface, {findings} AS findings FROM (SELECT *, {factor(OUTBOUND_FACTORS)} AS factor FROM ({rows}))"
    return judged(source, "Privacy risk in # area(s): ", "No privacy violations detected")


def entropy_runs(text: str = "text") -> str:
    return f"list_filter(regexp_extract_all({text}, {q(ENTROPY_RUN)}), lambda r: list_entropy(string_split(r, '')) >= 4.5)"


def redacted(text: str = "text", names: Sequence[str] = (), categories: Sequence[str] = CATEGORIES) -> str:
    for n in names:
        if n.strip():
            text = f"regexp_replace({text}, {q(re2(edge_name(n), PLAIN_FLAGS, keep_edges=True))}, '\\1[REDACTED]', 'g')"
    for r in PERSONAL:
        if r.redacts and set(r.categories) & set(categories):
            pattern = re2(r.pattern, OUTBOUND_FLAGS, keep_edges=True)
            kept = "\\1" if r"(?-m:(^|" in pattern else ""
            text = f"regexp_replace({text}, {q(pattern)}, '{kept}[REDACTED]', 'g')"
    return text


def sanitized(rows: str, **config) -> str:
    checked = outbound(rows, **config)
    how = {k: v for k, v in config.items() if k in ("names", "categories")}
    return f"""SELECT *, CASE WHEN is_safe THEN text WHEN blocked AND redacted = text THEN {q(BLOCKED_TEXT)} ELSE redacted END AS sanitized
               FROM (SELECT *, {redacted(**how)} AS redacted FROM ({checked}))"""

"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

_MIX = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
         (source_size * 2)::DOUBLE AS cap
  FROM totals),
ratios AS (SELECT *, cap / weight AS ratio FROM weighed),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER before, 0::DOUBLE))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0::DOUBLE)) AS level
  FROM ratios
  WINDOW before AS (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, least(cap, coalesce(weight * max(CASE WHEN level <= ratio THEN level END) OVER (), cap)) AS target
  FROM levels),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS word_start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
passes AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM placed)
SELECT doc_id, size, source_size, target,
       (epochs * size + least(greatest(budget - epochs * source_size - word_start, 0), size))::BIGINT AS taken
FROM passes
"""

_CHAT = r"""
WITH numbered AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, coalesce(md5(text), '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
coded AS (
  SELECT *, coalesce(length(role)::VARCHAR, 'n') || ':' || coalesce(role, '') || coalesce(length(text)::VARCHAR, 'n') || ':' || coalesce(text, '') AS code,
         '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS said
  FROM numbered),
prefixes AS (
  SELECT conv_id, pos, max(pos) OVER (PARTITION BY conv_id) AS n_turns,
         string_agg(code, '') OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix
  FROM coded),
whole AS (
  SELECT prefix, pos AS n_turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM prefixes WHERE pos = n_turns GROUP BY prefix, pos),
kept AS (
  SELECT conv_id, n_turns, n_copies FROM whole w
  WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.pos < p.n_turns AND p.pos = w.n_turns AND p.prefix = w.prefix))
SELECT k.conv_id, k.n_turns::INTEGER AS n_turns, k.n_copies, string_agg(c.said, '' ORDER BY c.pos) AS chat
FROM kept k JOIN coded c USING (conv_id) GROUP BY ALL
"""

_TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""

SQL = {"op1_topk": _TOPK, "op2_mix": _MIX, "op3_chat": _CHAT}

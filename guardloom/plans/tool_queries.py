"""Queries over tool calls, taint and policies, made of the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from guardloom.functions.dialect import PLAIN_FLAGS
from guardloom.functions.rules import PARAMETERS, PROFILES, SURFACES, TAINT_SOURCES, TOOL_SINKS
from guardloom.operators import inbound, policy, taint, toolcalls
from guardloom.plans import sql
from guardloom.plans.fixtures import INBOUND_PAYLOADS, PARAMS, TOOLS, pick, with_payload
from guardloom.plans.sql import chosen, q
from guardloom.sources.readers import spread
from guardloom.streaming import registry

MARK_SURFACES = (*TAINT_SOURCES, "internal", "web-page")
NEXT = ("tool-a", "agent-b", "file-c")
POLICY = {
    "defaults": {"use_llm": True},
    "agents": {
        "reader": {"allowed_surfaces": ["email", "public", "web-page"], "llm_threshold": 0.5, "surface_overrides": {"email": {"block_threshold": 0.6, "inbound_strict": False, "outbound_strict": True, "risk_multiplier": 1.5, "trust_level": "low", "note": "x"}}},
        "writer": {"check_credentials": False, "protected_names": ["Alice"]},
        "idle": {},
    },
    "surfaces": {"email": {"risk_multiplier": 1.3, "trust_level": "high"}, "internal": {"inbound_strict": True, "note": "y"}, "new-surface": {"outbound_strict": True}},
}
AGENT_NAMES = ("reader", "writer", "idle", "unknown")


def _events(spark, d) -> DataFrame:
    return spread(spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")))


def _key(divisor: int):
    return F.floor(F.col("event_id") / divisor).cast("long")


def _marks(spark, d) -> DataFrame:
    e = _events(spark, d)
    text = F.concat(F.lit("content "), (F.col("event_id") % 97).cast("string"))
    return e.select("event_id", "user_id", "ts", text.alias("text"), pick(MARK_SURFACES, _key(3)).alias("surface"))


_MARKS = f"""SELECT event_id, user_id, ts, 'content ' || (event_id % 97) AS text, {chosen(MARK_SURFACES, "(event_id // 3)")} AS surface FROM events"""
_SOURCE = "CASE surface " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in TAINT_SOURCES.items()) + " END"
_MARKED = f"""SELECT event_id, user_id, ts, surface, source, sha256(text)[1:16] AS content_hash, 'taint_' || sha256(text)[1:16] || '_' || ((epoch_us(ts) // 1000) % 100000) AS taint_id
  FROM (SELECT *, {_SOURCE} AS source FROM ({_MARKS})) WHERE source IS NOT NULL"""


def taint_mark(spark, d):
    return taint.mark(_marks(spark, d)).select("event_id", "taint_id", "content_hash", "source", F.array_join("path", ">").alias("path"))


def taint_evict(spark, d):
    kept = taint.evict(taint.mark(_marks(spark, d)), ["user_id"], ["ts", "event_id"], most=5)
    return kept.select("user_id", "event_id", "taint_id")


#: Events that start a chain: the others are steps from the event before them.
CHAIN = 40


def _entries(spark, d) -> DataFrame:
    marked = taint.mark(_marks(spark, d))
    return marked.select("event_id", F.concat(F.lit("e"), "event_id").alias("taint_id"), "content_hash", "source", "path")


def _roots(spark, d) -> DataFrame:
    return _entries(spark, d).where(F.col("event_id") % CHAIN == 0)


def _edges(spark, d) -> DataFrame:
    """A step from each event to the next, in chains of CHAIN - 3; the last two events of a chain
    derive each other, and the one before them leads back to the chain's start."""
    place, own = F.col("event_id") % CHAIN, F.col("event_id")
    back = F.when(place == CHAIN - 2, own + 1).otherwise(own - 1)
    name = lambda c: F.concat(F.lit("e"), c.cast("string"))
    events = _events(spark, d)
    steps = events.where(place != 0).select(name(back).alias("parent_id"), name(own).alias("child_id"), pick(NEXT, own).alias("next_surface"))
    loops = events.where(place == CHAIN - 3).select(name(own).alias("parent_id"), name(own - place).alias("child_id"), F.lit("again").alias("next_surface"))
    return steps.union(loops)


_RECURSIVE = f"""
  steps AS (SELECT event_id, CASE WHEN event_id % {CHAIN} = {CHAIN - 2} THEN event_id + 1 ELSE event_id - 1 END AS parent, {chosen(NEXT, "event_id")} AS next_surface FROM events WHERE event_id % {CHAIN} <> 0),
  reached AS (
    SELECT event_id, content_hash, source, surface AS path, 0 AS depth FROM ({_MARKED}) WHERE event_id % {CHAIN} = 0
    UNION ALL
    SELECT e.event_id, sha256(r.content_hash || e.next_surface)[1:16], r.source, r.path || '>' || e.next_surface, r.depth + 1
    FROM reached r JOIN steps e ON e.parent = r.event_id)"""


def taint_propagate(spark, d):
    return taint.propagate(_roots(spark, d), _edges(spark, d)).select("taint_id", "content_hash", "source", F.array_join("path", ">").alias("path"), "depth")


def _calls(spark, d) -> DataFrame:
    e = _events(spark, d)
    ids = F.array(F.lit("gone"), F.concat(F.lit("e"), (F.col("event_id") - F.col("event_id") % 5).cast("string")), F.lit("e0"))
    ids = F.when(F.col("event_id") % 2 == 0, ids).otherwise(F.array().cast("array<string>"))
    return e.select(F.col("event_id").alias("call_id"), pick(TOOLS, F.col("event_id")).alias("tool"), pick(PARAMS, _key(8)).alias("params_text"), ids.alias("taint_ids"))


#: Entries that a tracker of the stream keeps.
TRACKED = 5


def tracked_events(spark, d) -> DataFrame:
    """One row an event, by user: marks of untrusted content, propagations of the user's last
    mark, and calls that name an unknown id, the mark before the last one and the last one."""
    place = F.col("event_id") % 3
    role = F.when((place == 0) & taint.source_of(F.col("surface")).isNotNull(), "mark").when(place == 2, "propagate").otherwise("call")
    events = _marks(spark, d).withColumn("kind", role).withColumn("tracker_id", F.col("user_id").cast("string")).withColumn("seq", F.col("event_id"))
    earlier = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    own, is_mark = F.concat(F.lit("e"), "event_id"), F.col("kind") == "mark"
    events = events.withColumn("last", F.last(F.when(is_mark, own), ignorenulls=True).over(earlier))
    events = events.withColumn("before", F.last(F.when(is_mark, F.col("last")), ignorenulls=True).over(earlier))
    empty, none = F.array().cast("array<string>"), F.lit(None).cast("string")
    rest = (F.lit("").alias("tool"), F.lit("none").alias("sink"), F.lit(False).alias("param_hit"))
    marks = taint.mark(events.where(is_mark)).select(
        "tracker_id", "seq", "ts", "kind", own.alias("taint_id"), "source", "surface", *rest, empty.alias("taint_ids")
    )
    steps = events.where("kind = 'propagate'").select(
        "tracker_id", "seq", "ts", "kind", own.alias("taint_id"), none.alias("source"), pick(NEXT, F.col("event_id")).alias("surface"), *rest, F.array_compact(F.array("last")).alias("taint_ids")
    )
    calls = events.where("kind = 'call'").select(
        "tracker_id", "seq", "ts", pick(TOOLS, F.col("event_id")).alias("tool"), pick(PARAMS, _key(8)).alias("params_text"), F.array_compact(F.array(F.lit("gone"), "before", "last")).alias("taint_ids")
    )
    return marks.unionByName(steps).unionByName(registry.call_events(calls))


_SINK = "CASE lower(trim(tool)) " + " ".join(f"WHEN {q(t)} THEN {q(s)}" for s, tools in TOOL_SINKS.items() for t in tools) + " END"
_LAST = "CASE " + " ".join(f"WHEN {sql.matches(p, PLAIN_FLAGS, 'params_text')} THEN {q(s)}" for p, s in reversed(PARAMETERS)) + " END"
_ANY = " OR ".join(sql.matches(p, PLAIN_FLAGS, "params_text") for p, _ in PARAMETERS)
_CALLS = f"""SELECT event_id AS call_id, {chosen(TOOLS, "event_id")} AS tool, {chosen(PARAMS, "(event_id // 8)")} AS params_text,
  CASE WHEN event_id % 2 = 0 THEN ['gone', 'e' || (event_id - event_id % 5), 'e0'] ELSE [] END AS taint_ids FROM events"""


def taint_sink_classify(spark, d):
    calls = taint.check_calls(_calls(spark, d), _entries(spark, d))
    return calls.groupBy("tool", "sink").agg(F.count("*").alias("n"))


def taint_tool_check(spark, d):
    calls = taint.check_calls(_calls(spark, d), _entries(spark, d))
    return calls.select("call_id", "sink", "tainted", "source", "raw_score", "threat_level", "dangerous_flow", "is_safe", F.array_join("threat_types", ",").alias("types"), F.array_join("path", ">").alias("path"), "explanation")


def _checked(calls: str, newest: str = "") -> str:
    """The taint check of calls (call_id, tool, params_text, taint_ids): CTEs, the last is final."""
    return f"""
  entries AS (SELECT 'e' || event_id AS taint_id, source, surface AS path FROM ({_MARKED}){newest}),
  calls AS (SELECT *, coalesce({_SINK}, {_LAST}, 'none') AS sink, ({_ANY}) AS hit FROM ({calls})),
  wanted AS (SELECT c.call_id, e.*, row_number() OVER (PARTITION BY c.call_id ORDER BY u.pos) AS place FROM calls c, unnest(c.taint_ids) WITH ORDINALITY AS u(tid, pos) JOIN entries e ON e.taint_id = u.tid),
  scored AS (SELECT c.*, w.taint_id IS NOT NULL AS tainted, coalesce(w.source, 'none') AS source, w.path || '>tool:' || tool AS path, CASE WHEN hit THEN 0.8e0 ELSE 0e0 END AS p
             FROM calls c LEFT JOIN (SELECT * FROM wanted WHERE place = 1) w USING (call_id)),
  final AS (SELECT *, CASE WHEN sink IN ('shell_execution', 'code_eval') THEN CASE WHEN tainted THEN 0.95e0 ELSE greatest(p, 0.6e0) END
      WHEN sink IN ('file_write', 'network_request') THEN CASE WHEN tainted THEN 0.85e0 ELSE greatest(p, 0.45e0) END
      WHEN sink IN ('agent_instruction', 'llm_prompt') THEN CASE WHEN tainted THEN 0.9e0 ELSE greatest(p, 0.55e0) END
      WHEN sink = 'secret_access' THEN CASE WHEN tainted THEN 0.88e0 ELSE greatest(p, 0.5e0) END ELSE p END AS raw_score,
      tainted AND sink NOT IN ('none', 'agent_instruction') AS dangerous_flow FROM scored)"""


_CHECKED = _checked(_CALLS)


# JSON-RPC lines: arguments of all shapes, batches, broken lines, ids of marked content
_METHODS = ("tools/call", "tools/call", "tools/list", "tools/call", "initialize")
_SHAPES = ("{P}", "{P}", "{P}", "{N}", "{P}", "{L}", "{S}", "{P}", "{0}", "{P}", "{P}")
_ODD = {7: "{broken", 17: "5", 27: "[]", 37: '{"id":1,"method":["tools/call"]}', 47: '{"id":2,"method":"tools/call","params":[1]}'}


def _arguments(shape: str, value: str, number: str, join) -> str:
    """JSON text of arguments, put together by ``join`` out of texts and expressions."""
    parts = {
        "{P}": ('{"z":"', value, '","b":"item ', number, '"}'),
        "{N}": ('{"z":{"b":["', value, '",7],"a":', number, '},"c":true}'),
        "{L}": ('["', value, '",', number, ",null]"),
        "{S}": ('"', value, '"'),
        "{0}": ("null",),
    }
    return join(parts[shape])


def _lines(spark, d) -> DataFrame:
    literal = lambda parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    own = F.col("event_id")
    value, number = pick(PARAMS, _key(8)), (own % 10).cast("string")
    shaped = F.array(*[_arguments(s, value, number, literal) for s in _SHAPES])
    arguments = F.element_at(shaped, (own % len(_SHAPES) + 1).cast("int"))
    ids = F.when(own % 4 == 1, literal((',"_taint_ids":["gone","e', (own - own % 5).cast("string"), '"]'))).otherwise("")
    one = literal(('{"jsonrpc":"2.0","id":', own.cast("string"), ',"method":"', pick(_METHODS, own), '","params":{"name":"', pick(TOOLS, own), '","arguments":', arguments, ids, "}}"))
    body = F.when(own % 12 == 5, literal(("[", one, ',{"id":"second","method":"tools/call","params":{"name":"search","params":{"q":"', value, '"}}}]'))).otherwise(one)
    for place, text in _ODD.items():
        body = F.when(own % 50 == place, F.lit(text)).otherwise(body)
    return _events(spark, d).select(own.alias("line_id"), body.alias("body"))


def _sql_join(parts) -> str:
    return " || ".join(x if x.startswith("(") else q(x) for x in parts)


def _sql_body() -> str:
    value, number = f"({chosen(PARAMS, '(event_id // 8)')})", "((event_id % 10)::VARCHAR)"
    shaped = " ".join(f"WHEN {i} THEN {_sql_join(_arguments(s, value, number, list))}" for i, s in enumerate(_SHAPES))
    ids = """CASE WHEN event_id % 4 = 1 THEN ',"_taint_ids":["gone","e' || (event_id - event_id % 5) || '"]' ELSE '' END"""
    one = f"""'{{"jsonrpc":"2.0","id":' || event_id || ',"method":"' || {chosen(_METHODS, "event_id")} || '","params":{{"name":"' || {chosen(TOOLS, "event_id")} || '","arguments":' || (CASE event_id % {len(_SHAPES)} {shaped} END) || {ids} || '}}}}'"""
    two = f"""'[' || {one} || ',{{"id":"second","method":"tools/call","params":{{"name":"search","params":{{"q":"' || {value} || '"}}}}}}]'"""
    odd = " ".join(f"WHEN {k} THEN {q(v)}" for k, v in _ODD.items())
    return f"CASE event_id % 50 {odd} ELSE CASE WHEN event_id % 12 = 5 THEN {two} ELSE {one} END END"


_REQUESTS_OF_LINES = f"""
  lines AS (SELECT event_id AS line_id, {_sql_body()} AS body FROM events),
  split AS (
    SELECT line_id, 0 AS batch_pos, CASE WHEN json_valid(body) THEN body::JSON END AS req, json_valid(body) AS parsed_ok FROM lines WHERE NOT json_valid(body) OR coalesce(json_array_length(CASE WHEN json_valid(body) THEN body END), 0) = 0
    UNION ALL
    SELECT line_id, (u.pos - 1)::INTEGER, u.r, true FROM lines, unnest(json_extract(CASE WHEN json_valid(body) THEN body END, '$[*]')) WITH ORDINALITY AS u(r, pos) WHERE json_array_length(CASE WHEN json_valid(body) THEN body END) > 0),
  typed AS (
    SELECT *, line_id * 2 + batch_pos AS call_id, coalesce(req->>'$.method', '') AS m, json_type(req) = 'OBJECT' AND coalesce(json_type(req->'$.method'), 'VARCHAR') = 'VARCHAR' AS has_method FROM split),
  requests AS (
    SELECT *, parsed_ok AND coalesce(has_method, false) AND (m <> 'tools/call' OR coalesce(json_type(req->'$.params'), 'OBJECT') = 'OBJECT') AS valid,
      CASE WHEN has_method THEN m WHEN parsed_ok THEN '' END AS method,
      CASE WHEN has_method AND m = 'tools/call' THEN coalesce(req->>'$.params.name', '') WHEN parsed_ok THEN '' END AS tool,
      CASE WHEN json_type(req) = 'OBJECT' THEN (req->'$.id')::VARCHAR END AS rpc_id,
      CASE WHEN has_method AND m = 'tools/call' AND coalesce(json_type(req->'$.params'), 'OBJECT') = 'OBJECT' THEN coalesce(req->'$.params.arguments', req->'$.params.params') END AS args,
      CASE WHEN json_type(req->'$.params') = 'OBJECT' THEN json_extract_string(req, '$.params._taint_ids[*]') END AS taint_ids
    FROM typed),
  leaves AS (
    SELECT r.call_id, t.id AS place, t.type, json_type(r.args) AS whole, p.type AS above,
      CASE t.type WHEN 'NULL' THEN 'None' WHEN 'BOOLEAN' THEN CASE WHEN t.atom::VARCHAR = 'true' THEN 'True' ELSE 'False' END WHEN 'VARCHAR' THEN json_extract_string(t.atom, '$') ELSE t.atom::VARCHAR END AS said
    FROM (SELECT * FROM requests WHERE args IS NOT NULL) r, json_tree(r.args) t LEFT JOIN LATERAL (SELECT x.type FROM json_tree(r.args) x WHERE x.id = t.parent) p ON true
    WHERE t.type NOT IN ('OBJECT', 'ARRAY')),
  flat AS (
    SELECT call_id, string_agg(said, ' ' ORDER BY place) AS params_text,
      coalesce(string_agg(said, ' ' ORDER BY place) FILTER (WHERE whole <> 'OBJECT' OR above <> 'ARRAY' OR type = 'VARCHAR'), '') AS taint_text FROM leaves GROUP BY call_id)"""


def toolcall_parse(spark, d):
    return toolcalls.parse_lines(_lines(spark, d)).select("line_id", "batch_pos", "parsed_ok", "valid", "rpc_id", "method", "tool")


def toolcall_flatten(spark, d):
    """Flattened arguments, also through the column function and, where it holds, the expression."""
    parsed = toolcalls.parse_lines(_lines(spark, d)).where("params IS NOT NULL")
    plain = F.col("params").startswith('{"z": "')
    return parsed.select(
        "line_id", "batch_pos", "params_text", "taint_text", toolcalls.flatten_any(F.col("params")).alias("flat_any"),
        F.when(plain, toolcalls.flatten_strings(F.col("params"))).alias("flat"),
    )


def _decided(spark, d) -> DataFrame:
    parsed = toolcalls.parse_lines(_lines(spark, d))
    return toolcalls.decide(toolcalls.with_taint(parsed, _entries(spark, d), ["line_id"]))


def toolcall_decide(spark, d):
    return _decided(spark, d).select("line_id", "batch_pos", "call_risk", "blocked_call", "should_forward", "warn")


def toolcall_error(spark, d):
    get = lambda path: F.get_json_object("error", path)
    refused = _decided(spark, d).where("error IS NOT NULL")
    return refused.select("line_id", "batch_pos", "error_code", get("$.error.data.tool").alias("tool"), get("$.id").alias("rpc_id"), F.substring(get("$.error.message"), 1, 16).alias("says"))


_INBOUND_CALLS = sql.inbound("SELECT call_id AS id, params_text AS text, 'mcp-tool-call' AS surface FROM requests LEFT JOIN flat USING (call_id)")
_TOOL_SCORE = "CASE lower(tool) " + " ".join(f"WHEN {q(t)} THEN {s}e0" for t, s in toolcalls.TOOL_SCORES.items()) + " ELSE 0e0 END"
_NAMED_CALLS = "SELECT call_id, tool, taint_text AS params_text, taint_ids FROM requests JOIN flat USING (call_id) WHERE valid AND method = 'tools/call' AND len(taint_ids) > 0"
def _decided_sql(newest: str = "") -> str:
    return f"""{_REQUESTS_OF_LINES}, {_checked(_NAMED_CALLS, newest)},
  scanned AS (SELECT r.*, CASE WHEN valid AND method = 'tools/call' THEN greatest(c.risk_score, {_TOOL_SCORE}, coalesce(f.raw_score, 0e0)) END AS call_risk
              FROM requests r JOIN ({_INBOUND_CALLS}) c ON c.id = r.call_id LEFT JOIN (SELECT call_id, raw_score FROM final) f USING (call_id)),
  decided AS (SELECT *, coalesce(call_risk >= 0.7e0, false) AS blocked_call, valid AND NOT coalesce(call_risk >= 0.7e0, false) AS should_forward FROM scanned)"""


_DECIDED = _decided_sql()
_DECISIONS = "SELECT line_id, batch_pos, call_risk, blocked_call, should_forward, should_forward AND coalesce(call_risk > 0.3e0, false) AS warn FROM decided"


# policies
def _requests(spark, d) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select(F.col("doc_id").alias("id"), pick(AGENT_NAMES, F.col("doc_id")).alias("agent"), pick(SURFACES, F.floor(F.col("doc_id") / 4).cast("long")).alias("surface"))


def _effective(spark, d) -> DataFrame:
    agents, overrides = policy.policy_tables(spark, POLICY)
    return policy.effective(_requests(spark, d), agents, overrides, POLICY["defaults"])


def policy_effective_surface(spark, d):
    return _effective(spark, d)


def policy_allowed_documents(spark, d):
    return _effective(spark, d).where("allowed").groupBy("agent", "surface").agg(F.count("*").alias("n"))


def surface_profile_merge(spark, d):
    merged = policy.merged_profiles(policy.profiles(spark), policy.surface_table(spark, POLICY))
    return merged.select("surface", "trust_level", "inbound_strict", "outbound_strict", "risk_multiplier", F.col("extra").getItem("note").alias("note"))


def policy_block(spark, d):
    """Documents with a payload, checked, under the threshold of an agent's policy."""
    checked = inbound.check_inbound(with_payload(spread(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")), "doc_id", INBOUND_PAYLOADS))
    asked = checked.select("id", "surface", "raw_score", "blocked", pick(AGENT_NAMES, F.col("id")).alias("agent"))
    agents, overrides = policy.policy_tables(spark, POLICY)
    return policy.with_policy_block(policy.effective(asked, agents, overrides, POLICY["defaults"])).select("id", "agent", "surface", "raw_score", "blocked", "block_threshold", "policy_block")


_REQUESTS = f"SELECT doc_id AS id, {chosen(AGENT_NAMES, 'doc_id')} AS agent, {chosen(SURFACES, '(doc_id // 4)')} AS surface FROM documents"
_EFFECTIVE = f"""SELECT id, agent, surface, agent <> 'reader' OR surface IN ('email', 'public', 'web-page') AS allowed,
  CASE WHEN agent = 'reader' AND surface = 'email' THEN 0.6e0 ELSE 0.9e0 END AS block_threshold,
  CASE WHEN agent = 'reader' THEN 0.5e0 ELSE 0.35e0 END AS llm_threshold, true AS use_llm, agent <> 'writer' AS check_credentials, false AS check_high_entropy,
  NOT (agent = 'reader' AND surface = 'email') AS inbound_strict, agent = 'reader' AND surface = 'email' AS outbound_strict,
  CASE WHEN agent = 'reader' AND surface = 'email' THEN 1.5e0 ELSE 1e0 END AS risk_multiplier,
  CASE WHEN agent = 'reader' AND surface = 'email' THEN 'low' ELSE 'medium' END AS trust_level FROM ({_REQUESTS})"""
_PROFILES = ", ".join(f"({q(k)}, {q(v[0])}, {v[1]}, {v[2]}, {v[3]}e0)" for k, v in PROFILES.items())

_HITS = "[x for x in [" + ", ".join(f"CASE WHEN {sql.matches(p, PLAIN_FLAGS, 'params_text')} THEN {q('Dangerous pattern in params: ' + p[:50])} END" for p, _ in PARAMETERS) + "] if x IS NOT NULL]"
_EXPLAINED = f"""CASE WHEN tainted AND sink <> 'none' THEN 'Clinejection risk: tainted content from ' || source || ' flowing into ' || sink || ' via tool ''' || tool || '''' || CASE WHEN hit THEN '. ' || array_to_string({_HITS}[1:3], '; ') ELSE '' END
  WHEN hit THEN 'Dangerous patterns in tool ''' || tool || ''' params: ' || array_to_string({_HITS}[1:3], '; ') ELSE 'Tool call ''' || tool || ''' to sink ' || sink || ' — no taint detected' END AS explanation"""
_CALL_COLUMNS = "call_id, sink, tainted, source, raw_score, threat_level, dangerous_flow, NOT dangerous_flow AND raw_score < 0.45e0 AS is_safe, concat_ws(',', CASE WHEN hit THEN 'command_injection' END, CASE WHEN tainted AND sink <> 'none' THEN 'taint_flow' END) AS types, path, " + _EXPLAINED
SQL = {
    "taint_mark": f"SELECT event_id, taint_id, content_hash, source, surface AS path FROM ({_MARKED})",
    "taint_evict": f"SELECT user_id, event_id, taint_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM ({_MARKED})) WHERE n <= 5",
    "taint_propagate": f"WITH RECURSIVE {_RECURSIVE} SELECT 'e' || event_id AS taint_id, content_hash, source, path, depth FROM reached",
    "taint_sink_classify": f"WITH {_CHECKED} SELECT tool, sink, count(*) AS n FROM final GROUP BY ALL",
    "taint_tool_check": f"WITH {_CHECKED} SELECT {_CALL_COLUMNS} FROM (SELECT *, {sql.LEVEL} AS threat_level FROM final)",
    "toolcall_parse": f"WITH {_REQUESTS_OF_LINES} SELECT line_id, batch_pos, parsed_ok, valid, rpc_id, method, tool FROM requests",
    "toolcall_flatten": f"WITH {_REQUESTS_OF_LINES} SELECT line_id, batch_pos, params_text, taint_text, params_text AS flat_any, CASE WHEN args::VARCHAR LIKE '{{\"z\":\"%' THEN params_text END AS flat FROM requests JOIN flat USING (call_id)",
    "toolcall_decide": f"WITH {_DECIDED} {_DECISIONS}",
    "stream_toolcall_decide": f"WITH {_decided_sql(f' ORDER BY event_id DESC LIMIT {taint.MOST_ENTRIES}')} {_DECISIONS}",
    "toolcall_error": f"WITH {_DECIDED} SELECT line_id, batch_pos, CASE WHEN NOT parsed_ok THEN -32700 WHEN NOT valid THEN -32600 ELSE -32001 END AS error_code, CASE WHEN blocked_call THEN tool END AS tool, json_extract_string(rpc_id, '$') AS rpc_id, CASE WHEN NOT parsed_ok THEN 'Parse error' WHEN NOT valid THEN 'Invalid request' ELSE 'Tool call blocke' END AS says FROM decided WHERE NOT should_forward",
    "policy_effective_surface": _EFFECTIVE,
    "policy_allowed_documents": f"SELECT agent, surface, count(*) AS n FROM ({_EFFECTIVE}) WHERE allowed GROUP BY ALL",
    "surface_profile_merge": f"""SELECT surface, CASE surface WHEN 'email' THEN 'high' ELSE trust END AS trust_level, CASE surface WHEN 'internal' THEN true ELSE s_in END AS inbound_strict, s_out AS outbound_strict, CASE surface WHEN 'email' THEN 1.3e0 ELSE mult END AS risk_multiplier, CASE surface WHEN 'internal' THEN 'y' END AS note
      FROM (VALUES {_PROFILES}, ('new-surface', 'medium', true, true, 1e0)) AS t(surface, trust, s_in, s_out, mult)""",
    "policy_block": f"""SELECT c.id, e.agent, c.surface, c.raw_score, c.blocked, e.block_threshold, c.raw_score >= e.block_threshold AS policy_block
      FROM (SELECT *, {chosen(AGENT_NAMES, 'id')} AS agent_name FROM ({sql.inbound(sql.payload_rows('documents', 'doc_id', INBOUND_PAYLOADS))})) c
      JOIN (SELECT id, agent_name AS agent, CASE WHEN agent_name = 'reader' AND surface = 'email' THEN 0.6e0 ELSE 0.9e0 END AS block_threshold FROM (SELECT doc_id AS id, {chosen(AGENT_NAMES, 'doc_id')} AS agent_name, {chosen(SURFACES, 'doc_id')} AS surface FROM documents)) e USING (id)""",
    "stream_taint": f"""WITH roles AS (
        SELECT event_id, user_id, ts, surface, CASE WHEN event_id % 3 = 0 AND {_SOURCE} IS NOT NULL THEN 'mark' WHEN event_id % 3 = 2 THEN 'propagate' ELSE 'call' END AS kind, {_SOURCE} AS source FROM ({_MARKS})),
      grouped AS (SELECT *, count(*) FILTER (WHERE kind = 'mark') OVER line AS marks FROM roles WINDOW line AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
      ranked AS (SELECT *, count(*) FILTER (WHERE kind = 'propagate') OVER (PARTITION BY user_id, marks ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS nth FROM grouped),
      added AS (SELECT *, count(*) FILTER (WHERE kind = 'mark' OR kind = 'propagate' AND marks > 0 AND nth <= {TRACKED}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS adds FROM ranked),
      calls AS (SELECT *, {chosen(TOOLS, "event_id")} AS tool, {chosen(PARAMS, "(event_id // 8)")} AS params_text FROM added WHERE kind = 'call'),
      sunk AS (SELECT *, coalesce({_SINK}, {_LAST}, 'none') AS sink, CASE WHEN {_ANY} THEN 0.8e0 ELSE 0e0 END AS p FROM calls),
      joined AS (SELECT c.*, coalesce(b.source, a.source) AS from_source, coalesce(b.surface, a.surface) AS from_surface
        FROM sunk c LEFT JOIN (SELECT * FROM added WHERE kind = 'mark') a ON a.user_id = c.user_id AND a.marks = c.marks AND c.adds - a.adds < {TRACKED}
        LEFT JOIN (SELECT * FROM added WHERE kind = 'mark') b ON b.user_id = c.user_id AND b.marks = c.marks - 1 AND c.adds - b.adds < {TRACKED})
      SELECT user_id::VARCHAR AS tracker_id, event_id AS seq, tool, sink, from_source IS NOT NULL AS tainted, coalesce(from_source, 'none') AS source, from_surface || '>tool:' || tool AS path,
        CASE WHEN sink IN ('shell_execution', 'code_eval') THEN CASE WHEN from_source IS NOT NULL THEN 0.95e0 ELSE greatest(p, 0.6e0) END
          WHEN sink IN ('file_write', 'network_request') THEN CASE WHEN from_source IS NOT NULL THEN 0.85e0 ELSE greatest(p, 0.45e0) END
          WHEN sink IN ('agent_instruction', 'llm_prompt') THEN CASE WHEN from_source IS NOT NULL THEN 0.9e0 ELSE greatest(p, 0.55e0) END
          WHEN sink = 'secret_access' THEN CASE WHEN from_source IS NOT NULL THEN 0.88e0 ELSE greatest(p, 0.5e0) END ELSE p END AS raw_score
      FROM joined""",
}


def queries():
    found = (taint_mark, taint_evict, taint_propagate, taint_sink_classify, taint_tool_check, toolcall_parse, toolcall_flatten, toolcall_decide, toolcall_error, policy_effective_surface, policy_allowed_documents, surface_profile_merge, policy_block)
    return {f.__name__: f for f in found}


def oracle_sql():
    return dict(SQL)

"""JSON-RPC lines to tool calls, and what to do with them."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardloom.functions.rules import MILD_SHELLS, TOOL_SINKS
from guardloom.operators import taint
from guardloom.operators.inbound import check_inbound

BLOCK_FROM, WARN_FROM = 0.7, 0.3
PARSE_ERROR, INVALID_REQUEST, SECURITY_ERROR = -32700, -32600, -32001
SURFACE = "mcp-tool-call"
TAINT_KEY = "_taint_ids"
MOST_DEPTH, DEEP_CHARS = 5, 500
TOOL_SCORES = {t: 0.55 if t in MILD_SHELLS else 0.60 for t in TOOL_SINKS["shell_execution"]}
REQUEST = "request string, parsed_ok boolean, valid boolean, rpc_id string, method string, tool string, params string, params_text string, taint_text string, taint_ids array<string>"
_FIELDS = [x.split()[0] for x in REQUEST.split(", ")]


def flatten_python(value, depth: int = 0) -> str:
    """All values of a parsed JSON value in order, joined by spaces."""
    if depth > MOST_DEPTH:
        return str(value)[:DEEP_CHARS]
    if isinstance(value, str):
        return value
    if isinstance(value, (list, dict)):
        inner = value.values() if isinstance(value, dict) else value
        return " ".join(flatten_python(v, depth + 1) for v in inner)
    return str(value)


def flatten_for_taint(value) -> str:
    """The flavour of the taint check: of lists only the strings, mappings in mappings, all else as it prints."""
    if not isinstance(value, dict):
        return flatten_python(value)
    out: list[str] = []
    for v in value.values():
        if isinstance(v, list):
            out += [x for x in v if isinstance(x, str)]
        else:
            out.append(flatten_for_taint(v) if isinstance(v, dict) else str(v))
    return " ".join(out)


def _clean(text: str | None) -> str | None:
    """A string that can be encoded: JSON may hold halves of surrogate pairs."""
    return None if text is None else text.encode("utf-8", "replace").decode()


def _request(value, raw: str | None, taint_key: str) -> dict:
    """One request; ``valid`` is false where what it asks for cannot be read for sure."""
    out = dict.fromkeys(_FIELDS) | {"request": raw, "parsed_ok": True, "valid": False, "method": "", "tool": ""}
    if not isinstance(value, dict):
        return out
    if "id" in value:
        out["rpc_id"] = json.dumps(value["id"])
    method, params = value.get("method", ""), value.get("params", {})
    if not isinstance(method, str):
        return out
    out["method"] = method
    if method != "tools/call":
        return out | {"valid": True}
    if not isinstance(params, dict) or not isinstance(params.get("name", ""), str):
        return out
    arguments = params.get("arguments", params.get("params", {}))
    ids = params.get(taint_key)
    return out | {
        "valid": True,
        "tool": params.get("name", ""),
        "params": json.dumps(arguments),
        "params_text": flatten_python(arguments),
        "taint_text": flatten_for_taint(arguments),
        "taint_ids": [x for x in ids if isinstance(x, str)] if isinstance(ids, list) else None,
    }


def read_requests(raw: bytes | None, taint_key: str = TAINT_KEY) -> list[dict]:
    """The requests of one line: one, those of a batch, or one that says what is wrong."""
    text = None if raw is None else raw.decode("utf-8", "replace")
    broken = dict.fromkeys(_FIELDS) | {"request": text, "parsed_ok": False, "valid": False}
    if text is None:
        return [broken]
    try:
        value = json.loads(text)
        if isinstance(value, list) and value:
            return [_request(v, json.dumps(v), taint_key) for v in value]
        return [_request(value, text, taint_key)]
    except (ValueError, RecursionError):
        return [broken]


def parse_lines(lines: DataFrame, body: str = "body", taint_key: str = TAINT_KEY) -> DataFrame:
    """Rows of ``lines``, one a request, with batch_pos and REQUEST's columns.

    A JSON array is a batch: each of its requests is a row with its own ``request`` text, so
    nothing is passed on that was not looked at.  What is no JSON has parsed_ok false; what is
    no request, an empty batch, a call whose method, params or name have another type, has
    valid false.  ``rpc_id`` and ``params`` are JSON text; params_text is the flattened
    arguments, taint_text the taint check's flavour of it.

    This is Python, in Arrow batches: arguments nest to any depth, and the flattened text has
    to keep the order of keys, which VARIANT does not, and print numbers and constants as the
    checks expect them.  Only the line crosses, once.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([(f, pa.bool_() if f in ("parsed_ok", "valid") else pa.list_(pa.string()) if f == "taint_ids" else pa.string()) for f in _FIELDS]))
        for batch in batches:
            found = [read_requests(x, taint_key) for x in batch.to_pylist()]
            for r in (r for line in found for r in line):
                for f, v in r.items():
                    if isinstance(v, str):
                        r[f] = _clean(v)
                    elif isinstance(v, list):
                        r[f] = [_clean(x) for x in v]
            yield pa.array(found, kind)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    requests = F.arrow_udf(run, f"array<struct<{REQUEST.replace(' ', ':').replace(',:', ',')}>>")(F.col(body).cast("binary"))
    rows = lines.select("*", F.posexplode(requests).alias("batch_pos", "_r"))
    return rows.select(*lines.columns, "batch_pos", "_r.*")


def flatten_any(params: Column) -> Column:
    """Flattened text of a column of JSON text."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if x is None else _clean(flatten_python(json.loads(x))) for x in batch.to_pylist()], pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "string")(params)


def flatten_strings(params: Column) -> Column:
    """The same for an object whose values are strings or whole numbers, as an expression."""
    return F.array_join(F.map_values(F.from_json(params, "map<string,string>")), " ")


def with_taint(parsed: DataFrame, registry: DataFrame, key: list[str]) -> DataFrame:
    """Adds taint_score to parsed calls that name ids: the score of the taint check against a
    registry (taint_id, source, path).  ``key`` names the columns that tell the lines apart."""
    named = parsed.where(F.col("valid") & (F.col("method") == "tools/call") & (F.size("taint_ids") > 0))
    own = F.struct(*key, "batch_pos")
    calls = named.select(own.alias("call_id"), "tool", F.col("taint_text").alias("params_text"), "taint_ids")
    scores = taint.check_calls(calls, registry).select("call_id", F.col("risk_score").alias("taint_score"))
    return parsed.withColumn("call_id", own).join(scores, "call_id", "left").drop("call_id")


def decide(
    parsed: DataFrame, params_text: Column | None = None, taint_score: Column | None = None, block_from: float = BLOCK_FROM
) -> DataFrame:
    """Adds the inbound check of the parameters, the decision and the error to send back.

    Only ``tools/call`` is looked at; other methods pass.  What is not JSON or not a request
    that can be read is refused.  A column taint_score (with_taint()) counts if there is one.
    """
    if taint_score is None and "taint_score" in parsed.columns:
        taint_score = F.col("taint_score")
    text = F.col("params_text") if params_text is None else params_text
    scanned = parsed.withColumn("params_text", text).withColumn("surface", F.lit(SURFACE))
    checked = check_inbound(scanned, text="params_text")
    pairs = [F.lit(x) for pair in TOOL_SCORES.items() for x in pair]
    tool_score = F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower("tool")), F.lit(0.0))
    call = F.col("valid") & (F.col("method") == "tools/call")
    tainted = F.lit(0.0) if taint_score is None else F.coalesce(taint_score, F.lit(0.0))
    risk = F.greatest(F.col("risk_score"), tool_score, tainted)
    out = checked.withColumn("call_risk", F.when(call, risk)).withColumn("blocked_call", F.coalesce(F.col("call_risk") >= block_from, F.lit(False)))
    forward = F.col("valid") & ~F.col("blocked_call")
    code = F.when(~F.col("parsed_ok"), PARSE_ERROR).when(~F.col("valid"), INVALID_REQUEST).when(F.col("blocked_call"), SECURITY_ERROR)
    data = F.struct(
        F.col("tool").alias("tool"),
        F.col("call_risk").alias("risk_score"),
        F.slice("matched_rules", 1, 5).alias("matched_patterns"),
        F.lit(True).alias("blocked"),
    )
    why = F.concat(F.lit("Tool call blocked by the content guard (risk="), F.format_string("%.2f", "call_risk"), F.lit("): "), "explanation")
    message = F.when(~F.col("parsed_ok"), "Parse error").when(~F.col("valid"), "Invalid request").otherwise(why)
    error = F.struct(code.alias("code"), message.alias("message"), F.when(F.col("blocked_call"), data).alias("data"))
    reply = F.concat(F.lit('{"jsonrpc":"2.0","id":'), F.coalesce("rpc_id", F.lit("null")), F.lit(',"error":'), F.to_json(error), F.lit("}"))
    return out.withColumns(
        {
            "should_forward": forward,
            "warn": forward & F.coalesce(F.col("call_risk") > WARN_FROM, F.lit(False)),
            "error_code": code,
            "error": F.when(code.isNotNull(), reply),
        }
    )


def kept_headers(headers: Column, allowed: tuple[str, ...] = ("Authorization", "X-API-Key")) -> Column:
    """Headers that are passed on: those allowed by name, and all that begin with content-."""
    return F.map_filter(headers, lambda k, _: k.isin(*allowed) | F.lower(k).startswith("content-"))

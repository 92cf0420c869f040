"""Taint, tool calls, policies and streams."""

import datetime as dt
import json

import pytest
from guardloom.operators import policy, taint, toolcalls
from guardloom.streaming import queries as streams
from guardloom.streaming import registry
from pyspark.sql import functions as F

NOW = dt.datetime(2024, 1, 1)


def test_only_untrusted_surfaces_are_marked(spark):
    rows = [("x", s, NOW) for s in ("email", "direct-message", "web-page", "internal", "nowhere", None)]
    got = taint.mark(spark.createDataFrame(rows, "text string, surface string, ts timestamp")).collect()
    assert {(r["surface"], r["source"]) for r in got} == {("email", "email"), ("direct-message", "user_input")}
    assert all(r["taint_id"].startswith(f"taint_{r['content_hash']}_") and len(r["content_hash"]) == 16 for r in got)


def entries(spark):
    return spark.createDataFrame([("t1", "h1", "email", ["email"]), ("t2", "h2", "web_page", ["web-content"])], "taint_id string, content_hash string, source string, path array<string>")


def test_propagation(spark):
    edges = spark.createDataFrame([("t1", "a", "x"), ("a", "b", "y"), ("gone", "c", "z")], "parent_id string, child_id string, next_surface string")
    got = {r["taint_id"]: r for r in taint.propagate(entries(spark), edges).collect()}
    assert set(got) == {"t1", "t2", "a", "b"} and got["b"]["path"] == ["email", "x", "y"] and got["b"]["source"] == "email"


def test_eviction_keeps_the_newest(spark):
    rows = spark.range(1001).select(F.lit("k").alias("key"), F.col("id").alias("ts"))
    assert taint.evict(rows, ["key"], ["ts"]).agg(F.min("ts"), F.count("*")).first() == (1, 1000)


@pytest.mark.parametrize(
    "tool, text, ids, sink, score, source",
    [
        ("bash", "ls", ["t1"], "shell_execution", 0.95, "email"),
        (" BASH ", "ls", [], "shell_execution", 0.60, "none"),
        ("write_file", "x", ["gone", "t2", "t1"], "file_write", 0.85, "web_page"),
        ("search", "x", ["t1"], "none", 0.0, "email"),
        ("search", "eval(1)", [], "code_eval", 0.80, "none"),
        ("search", "ignore previous instructions", ["t1"], "llm_prompt", 0.90, "email"),
        ("search", None, None, "none", 0.0, "none"),
    ],
)
def test_tool_calls(spark, tool, text, ids, sink, score, source):
    calls = spark.createDataFrame([(1, tool, text, ids)], "call_id long, tool string, params_text string, taint_ids array<string>")
    got = taint.check_calls(calls, entries(spark)).first()
    assert (got["sink"], got["raw_score"], got["source"]) == (sink, score, source)


def test_json_rpc_lines(spark):
    call = lambda name, args, method="tools/call": json.dumps({"jsonrpc": "2.0", "id": 7, "method": method, "params": {"name": name, "arguments": args}})
    bodies = [call("search", {"q": "weather"}), call("bash", {"q": "x | bash"}), call("bash", {"q": "x | bash"}, "tools/list"), "{bad", None, call("sh", {})]
    frame = spark.createDataFrame(list(enumerate(bodies)), "i int, body string")
    out = toolcalls.decide(toolcalls.parse_lines(frame), toolcalls.flatten_any(F.col("params")))
    got = {r["i"]: r for r in out.collect()}
    assert [got[i]["should_forward"] for i in range(6)] == [True, False, True, False, False, True]
    assert [got[i]["error_code"] for i in range(6)] == [None, -32001, None, -32700, -32700, None]
    error = json.loads(got[1]["error"])["error"]["data"]
    assert error["tool"] == "bash" and error["blocked"] and "CI-001" in error["matched_patterns"]
    assert got[5]["call_risk"] == 0.60 and got[5]["warn"] and not got[0]["warn"]


def test_flatten():
    assert toolcalls.flatten_python({"a": "x", "b": [1, {"c": None, "d": True}], "e": []}) == "x 1 None True "
    deep = {"a": {"a": {"a": {"a": {"a": {"a": {"a": "x"}}}}}}}
    assert toolcalls.flatten_python(deep) == "{'a': 'x'}"


def test_headers(spark):
    frame = spark.createDataFrame([({"Content-Type": "a", "X-API-Key": "b", "Cookie": "c"},)], "h map<string,string>")
    assert frame.select(toolcalls.kept_headers(F.col("h")).alias("h")).first()["h"] == {"Content-Type": "a", "X-API-Key": "b"}


def test_policy_folders_merge(tmp_path, monkeypatch):
    (tmp_path / "a.json").write_text(json.dumps({"defaults": {"block_threshold": 0.5}, "agents": {"x": {"use_llm": True}, "y": {}}}))
    (tmp_path / "b.json").write_text(json.dumps({"defaults": {"block_threshold": 0.9}, "agents": {"x": {"use_llm": False}}}))
    got = policy.read_policy(str(tmp_path))
    assert got["defaults"] == {"block_threshold": 0.5} and got["agents"] == {"x": {"use_llm": False}, "y": {}}
    monkeypatch.setenv(policy.ENVIRONMENT, str(tmp_path / "b.json"))
    assert policy.read_policy()["defaults"] == {"block_threshold": 0.9}
    with pytest.raises(FileNotFoundError):
        policy.read_policy(str(tmp_path / "none"))


def test_policy_layers(spark):
    p = {"agents": {"a": {"block_threshold": 0.6, "allowed_surfaces": ["email"], "surface_overrides": {"email": {"block_threshold": 0.4}}}}}
    agents, overrides = policy.policy_tables(spark, p)
    asked = spark.createDataFrame([("a", "email"), ("a", "public"), ("b", "email")], "agent string, surface string")
    got = {(r["agent"], r["surface"]): r for r in policy.effective(asked, agents, overrides, {"block_threshold": 0.8}).collect()}
    assert [got[k]["block_threshold"] for k in (("a", "email"), ("a", "public"), ("b", "email"))] == [0.4, 0.6, 0.8]
    assert [got[k]["allowed"] for k in (("a", "email"), ("a", "public"), ("b", "email"))] == [True, False, True]


def test_streamed_registry_agrees_with_a_replay_by_hand(spark):
    stamp = lambda n: NOW + dt.timedelta(seconds=n)
    no = [None] * 3
    rows = [
        ("u", 1, stamp(1), "mark", "m1", "email", "email", "", "none", False, []),
        ("u", 2, stamp(2), "mark", "m2", "email", "email", "", "none", False, []),
        ("u", 3, stamp(3), "propagate", "p1", None, "tool-a", "", "none", False, ["m2"]),
        ("u", 4, stamp(4), "call", *no, "bash", "shell_execution", False, ["m1"]),  # evicted by p1
        ("u", 5, stamp(5), "call", *no, "bash", "shell_execution", False, ["p1"]),
        ("v", 6, stamp(6), "call", *no, "bash", "shell_execution", True, ["m1"]),
    ]
    frame = spark.createDataFrame(rows, registry.EVENTS)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
    try:
        got = streams.replay(spark, frame, lambda s: registry.track(s, most=2), "seq tainted path raw_score").collect()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert sorted(map(tuple, got)) == [(4, False, None, 0.60), (5, True, "email>tool-a>tool:bash", 0.95), (6, False, None, 0.80)]

"""Policies as dimension tables, and what holds for an agent on a surface."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guardloom.functions.rules import CATEGORIES, PROFILES
from guardloom.operators.outbound import PrivacyConfig

ENVIRONMENT = "GUARDLOOM_POLICY"
# Constants that hold where no layer says otherwise.
DEFAULTS = {"block_threshold": 0.9, "llm_threshold": 0.35, "use_llm": False, "check_credentials": True, "check_high_entropy": False}
_SETTINGS = "block_threshold double, llm_threshold double, use_llm boolean"
AGENTS = f"agent string, allowed_surfaces array<string>, protected_names array<string>, disabled_rules array<string>, check_credentials boolean, check_high_entropy boolean, {_SETTINGS}, extra map<string,string>"
OVERRIDES = f"agent string, surface string, {_SETTINGS}, inbound_strict boolean, outbound_strict boolean, risk_multiplier double, trust_level string, extra map<string,string>"
_KNOWN = {x.split()[0] for x in OVERRIDES.split(", ")} - {"agent", "surface", "extra"}
_AGENT_KNOWN = {x.split()[0] for x in AGENTS.split(", ")} - {"agent", "extra", "disabled_rules"} | {"disabled_cred_rules", "surface_overrides"}
SURFACE_PROFILES = "surface string, trust_level string, inbound_strict boolean, outbound_strict boolean, risk_multiplier double, extra map<string,string>"
_PROFILE_KNOWN = ("trust_level", "inbound_strict", "outbound_strict", "risk_multiplier")


def read_policy(path: str | None = None) -> dict:
    """A policy from a file, a folder of files, the environment's file, or the built-in defaults.

    YAML where a reader is installed, JSON else.  In a folder, files are taken by name:
    later agents and surfaces win, the first file's defaults stay.
    """
    path = path or os.environ.get(ENVIRONMENT)
    if not path:
        return {"version": 1, "defaults": {}, "agents": {}, "surfaces": {}}
    p = Path(path)
    if not p.exists():
        raise FileNotFoundError(path)
    files = sorted(x for x in p.iterdir() if x.suffix in (".yml", ".yaml", ".json")) if p.is_dir() else [p]
    out: dict = {"version": 1, "defaults": {}, "agents": {}, "surfaces": {}}
    for n, f in enumerate(files):
        one = _parse(f.read_text(encoding="utf-8")) or {}
        if not isinstance(one, dict):
            raise ValueError(f"{f}: a policy is a mapping")
        if n == 0:
            out["version"], out["defaults"] = one.get("version", 1), one.get("defaults") or {}
        out["agents"] |= one.get("agents") or {}
        out["surfaces"] |= one.get("surfaces") or {}
    return out


def _parse(text: str):
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    try:
        return yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ValueError(f"not a policy: {e}") from e


def policy_tables(spark: SparkSession, policy: dict) -> tuple[DataFrame, DataFrame]:
    """(agents, overrides of surfaces by agent) of a parsed policy."""
    agents, overrides = [], []
    for name, a in (policy.get("agents") or {}).items():
        a = a or {}
        row = [name, *(list(a.get(k) or []) for k in ("allowed_surfaces", "protected_names", "disabled_cred_rules"))]
        more = {k: str(v) for k, v in a.items() if k not in _AGENT_KNOWN}
        agents.append((*row, a.get("check_credentials"), a.get("check_high_entropy"), *_settings(a), more))
        for surface, s in (a.get("surface_overrides") or {}).items():
            s = s or {}
            extra = {k: str(v) for k, v in s.items() if k not in _KNOWN}
            overrides.append((name, surface, *_settings(s), s.get("inbound_strict"), s.get("outbound_strict"), _number(s.get("risk_multiplier")), s.get("trust_level"), extra))
    return spark.createDataFrame(agents, AGENTS), spark.createDataFrame(overrides, OVERRIDES)


def surface_table(spark: SparkSession, policy: dict) -> DataFrame:
    """The policy's own ``surfaces``, which hold for all agents: one row a surface."""
    rows = []
    for surface, s in (policy.get("surfaces") or {}).items():
        s = s or {}
        extra = {k: str(v) for k, v in s.items() if k not in _PROFILE_KNOWN}
        rows.append((surface, s.get("trust_level"), s.get("inbound_strict"), s.get("outbound_strict"), _number(s.get("risk_multiplier")), extra))
    return spark.createDataFrame(rows, SURFACE_PROFILES)


def _number(x):
    return None if x is None else float(x)


def _settings(x: dict) -> tuple:
    return _number(x.get("block_threshold")), _number(x.get("llm_threshold")), x.get("use_llm")


def profiles(spark: SparkSession) -> DataFrame:
    rows = [(k, *v[:4], list(v[4])) for k, v in PROFILES.items()]
    return spark.createDataFrame(rows, "surface string, trust_level string, inbound_strict boolean, outbound_strict boolean, risk_multiplier double, watch_for array<string>")


def merged_profiles(base: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Built-in profiles under a policy's ``surfaces`` (surface_table()), field by field; surfaces of either side.

    Overrides of single agents have no part in this; they are what effective() is for."""
    o = surfaces.select("surface", "extra", *[F.col(c).alias(f"o_{c}") for c in _PROFILE_KNOWN])
    both = base.join(o, "surface", "full")
    unknown = {"trust_level": "medium", "inbound_strict": True, "outbound_strict": False, "risk_multiplier": 1.0}
    return both.select("surface", *[F.coalesce(f"o_{c}", c, F.lit(d)).alias(c) for c, d in unknown.items()], "extra")


def effective(requests: DataFrame, agents: DataFrame, overrides: DataFrame, defaults: dict | None = None) -> DataFrame:
    """requests (agent, surface, ...) with the settings that hold for each.

    Thresholds and use_llm: surface, then agent, then defaults, then constants.  Strictness,
    factor and trust: surface, then constants.  An agent without a list may use any surface;
    an unknown agent has the defaults.
    """
    d = DEFAULTS | {k: v for k, v in (defaults or {}).items() if v is not None}
    a = agents.select(F.col("agent").alias("a_agent"), "allowed_surfaces", *[F.col(c).alias(f"a_{c}") for c in DEFAULTS])
    o = overrides.select(F.col("agent").alias("o_agent"), F.col("surface").alias("o_surface"), *[F.col(c).alias(f"o_{c}") for c in ("block_threshold", "llm_threshold", "use_llm")], "inbound_strict", "outbound_strict", "risk_multiplier", "trust_level")
    out = requests.join(a, F.col("agent") == F.col("a_agent"), "left").join(o, (F.col("agent") == F.col("o_agent")) & (F.col("surface") == F.col("o_surface")), "left")
    layered = {c: F.coalesce(f"o_{c}", f"a_{c}", F.lit(d[c])) for c in ("block_threshold", "llm_threshold", "use_llm")}
    agent_only = {c: F.coalesce(f"a_{c}", F.lit(d[c])) for c in ("check_credentials", "check_high_entropy")}
    flat = {"inbound_strict": True, "outbound_strict": False, "risk_multiplier": 1.0, "trust_level": "medium"}
    allowed = F.coalesce((F.size("allowed_surfaces") <= 0) | F.array_contains("allowed_surfaces", F.col("surface")), F.lit(True))
    return out.select(
        *requests.columns,
        allowed.alias("allowed"),
        *[v.alias(k) for k, v in (layered | agent_only).items()],
        *[F.coalesce(F.col(k), F.lit(v)).alias(k) for k, v in flat.items()],
    )


def with_policy_block(checked: DataFrame) -> DataFrame:
    """Adds policy_block: the unrounded score reaches the block_threshold of effective().

    The checks' own ``blocked`` does not depend on a policy and stays as it is."""
    return checked.withColumn("policy_block", F.col("raw_score") >= F.col("block_threshold"))


def to_dict(policy: dict) -> dict:
    """A parsed policy with what holds for each agent and for each of its surfaces written out."""
    d = DEFAULTS | {k: v for k, v in (policy.get("defaults") or {}).items() if v is not None}
    agents = {}
    for name, a in (policy.get("agents") or {}).items():
        a = a or {}
        own = {k: a.get(k, d[k]) for k in ("use_llm", "llm_threshold", "block_threshold")}
        surfaces = {}
        for surface, s in (a.get("surface_overrides") or {}).items():
            s = s or {}
            flat = {"inbound_strict": True, "outbound_strict": False, "risk_multiplier": 1.0, "trust_level": "medium"}
            surfaces[surface] = {"surface": surface} | {k: s.get(k, v) for k, v in (own | flat).items()}
        listed = {k: list(a.get(k) or []) for k in ("allowed_surfaces", "protected_names", "disabled_cred_rules")}
        agents[name] = {"name": name, **listed, "surface_overrides": surfaces, "check_credentials": a.get("check_credentials", d["check_credentials"]), **own}
    return {"version": int(policy.get("version", 1)), "defaults": policy.get("defaults") or {}, "agents": agents, "global_surface_overrides": policy.get("surfaces") or {}}


def privacy_config(agent: dict, check_credentials: bool = True) -> PrivacyConfig:
    """The outbound configuration of one agent of a parsed policy; all categories stay on."""
    on, judge_from = agent.get("check_credentials"), agent.get("llm_threshold")
    return PrivacyConfig(
        protected_names=tuple(agent.get("protected_names") or ()),
        categories=CATEGORIES,
        check_credentials=check_credentials if on is None else on,
        disabled_rules=tuple(agent.get("disabled_cred_rules") or ()),
        check_high_entropy=bool(agent.get("check_high_entropy")),
        judge_from=DEFAULTS["llm_threshold"] if judge_from is None else float(judge_from),
    )


def agent_names(policy: dict) -> list[str]:
    return sorted(policy.get("agents") or {})


def family_config(names: tuple[str, ...]) -> PrivacyConfig:
    """Protects the given names and looks for every category."""
    return PrivacyConfig(protected_names=tuple(names))

"""Untrusted content from where it came in to the tool calls it reaches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guardloom.functions import scoring as S
from guardloom.functions.dialect import PLAIN_FLAGS, java
from guardloom.functions.rules import PARAMETERS, TAINT_SOURCES, TOOL_SINKS
from guardloom.sources.shared import settle

MOST_ENTRIES = 1000
SINK_OF = {tool: sink for sink, tools in TOOL_SINKS.items() for tool in tools}
# Score of a sink when tainted content reaches it, and least score when not.
SINK_SCORES = {
    "shell_execution": (0.95, 0.60), "code_eval": (0.95, 0.60), "file_write": (0.85, 0.45), "network_request": (0.85, 0.45),
    "agent_instruction": (0.90, 0.55), "llm_prompt": (0.90, 0.55), "secret_access": (0.88, 0.50),
}
PARAMETER_SCORE = 0.80


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def _map(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def source_of(surface: Column) -> Column:
    """The untrusted source of a surface, null for a trusted or unknown one."""
    return _map(TAINT_SOURCES, surface)


def mark(contents: DataFrame, text: str = "text", surface: str = "surface", ts: str = "ts") -> DataFrame:
    """Registry entries of the rows whose surface is untrusted: taint_id, content_hash, source, path.

    Ids are made of the content's hash and the event time, not of a clock.  Null text counts as empty.
    """
    millis = F.pmod(F.unix_millis(F.col(ts)), F.lit(100000)).cast("string")
    body = F.coalesce(F.col(text), F.lit(""))
    out = contents.withColumn("source", source_of(F.col(surface))).where("source IS NOT NULL")
    out = out.withColumn("content_hash", short_hash(body))
    return out.withColumn("taint_id", F.concat_ws("_", F.lit("taint"), "content_hash", millis)).withColumn("path", F.array(surface))


def evict(entries: DataFrame, by: list[str], newest: list[str], most: int = MOST_ENTRIES) -> DataFrame:
    """The ``most`` newest entries of each registry."""
    line = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in newest])
    return entries.withColumn("_n", F.row_number().over(line)).where(F.col("_n") <= most).drop("_n")


def propagate(entries: DataFrame, edges: DataFrame) -> DataFrame:
    """Entries (taint_id, content_hash, source, path) and all that edges (parent_id, child_id,
    next_surface) derive from them, with ``depth``, the number of steps.

    An id is made once: of several edges into one id the smallest (parent_id, next_surface)
    counts, and none into an id that is an entry.  Edges from unknown ids derive nothing, so
    neither do cycles.  Repeated entries derive as often.  Null ids are not followed; a null
    surface counts as empty.

    Chains have any length: each id points to the one above it, and each round takes the
    pointers that have not come to a chain's start twice as far, so a chain of n steps needs
    about log2(n) joins.  Rounds are written to the shared folder; they end when none gets there any more.
    """
    roots = entries.select("taint_id", "content_hash", "source", "path")
    surface = F.coalesce("next_surface", F.lit("")).alias("next_surface")
    known = edges.where("parent_id IS NOT NULL AND child_id IS NOT NULL").select("child_id", "parent_id", surface)
    first = known.groupBy("child_id").agg(F.min(F.struct("parent_id", "next_surface")).alias("edge"))
    first = first.join(roots.select(F.col("taint_id").alias("child_id")), "child_id", "left_anti")
    first = settle(first.select("child_id", F.col("edge.parent_id").alias("above"), F.array("edge.next_surface").alias("steps")), "taint-edges")
    children = first.select(F.col("child_id").alias("above"))
    done, ahead = first.join(children, "above", "left_anti").select(*first.columns), first.join(children, "above", "left_semi").select(*first.columns)
    before = ahead.count()
    while before:
        jump = done.withColumn("there", F.lit(True)).unionByName(ahead.withColumn("there", F.lit(False)))
        jump = jump.select(F.col("child_id").alias("j_id"), F.col("above").alias("j_above"), F.col("steps").alias("j_steps"), "there")
        moved = ahead.join(jump, F.col("above") == F.col("j_id"))
        moved = settle(moved.select("child_id", F.col("j_above").alias("above"), F.concat("j_steps", "steps").alias("steps"), "there"), "taint-edges")
        done, ahead = done.unionByName(moved.where("there").drop("there")), moved.where("NOT there").drop("there")
        n = ahead.count()
        if n == before:  # what is left goes in circles
            break
        before = n
    reached = done.join(roots, done["above"] == roots["taint_id"])
    derived = reached.select(
        F.col("child_id").alias("taint_id"),
        F.aggregate("steps", F.col("content_hash"), lambda h, s: short_hash(F.concat(h, s))).alias("content_hash"),
        "source",
        F.concat("path", "steps").alias("path"),
        F.size("steps").alias("depth"),
    )
    return roots.withColumn("depth", F.lit(0)).unionByName(derived)


def get_entry(entries: DataFrame, taint_id: str) -> DataFrame:
    """The registry's entry of one id: a row or none."""
    return entries.where(F.col("taint_id") == taint_id)


def cleared(entries: DataFrame) -> DataFrame:
    """An empty registry with the same columns."""
    return entries.limit(0)


def parameter_hits(text: Column) -> Column:
    found = [F.when(text.rlike(java(p, PLAIN_FLAGS)), F.lit(i)) for i, (p, _) in enumerate(PARAMETERS, 1)]
    return F.array_compact(F.array(*found))


def sink_of_tool(tool: Column) -> Column:
    return _map(SINK_OF, F.lower(F.regexp_replace(tool, r"(?U)^\s+|\s+$", "")))


def with_sinks(calls: DataFrame, text: str) -> DataFrame:
    """Adds param_hits and sink to calls with tool and a column of flattened parameters."""
    sinks = F.array(*[F.lit(s) for _, s in PARAMETERS])
    found = S.once(F.coalesce(parameter_hits(F.coalesce(F.col(text), F.lit(""))), F.array().cast("array<int>")))
    last = F.when(F.size("param_hits") > 0, F.element_at(sinks, F.element_at("param_hits", -1)))
    return calls.withColumn("param_hits", found).withColumn("sink", F.coalesce(sink_of_tool(F.col("tool")), last, F.lit("none")))


def check_calls(calls: DataFrame, entries: DataFrame) -> DataFrame:
    """Calls (call_id, tool, params_text, taint_ids) with sink, taint and score.

    The first of a call's ids that the registry knows is its taint.  The sink is the tool's
    own, or else that of the last matching parameter pattern.
    """
    named = with_sinks(calls, "params_text")
    wanted = named.select("call_id", F.posexplode("taint_ids").alias("pos", "taint_id")).join(
        entries.select("taint_id", "source", "path"), "taint_id"
    )  # a hot id: many small rows against one, which adaptive execution splits
    first = wanted.groupBy("call_id").agg(F.min_by(F.struct("taint_id", "source", "path"), "pos").alias("entry"))
    joined = named.join(first, "call_id", "left")
    return scored(joined)


def scored(joined: DataFrame) -> DataFrame:
    """Adds score, level and what follows to calls with sink, param_hits and entry."""
    tainted = F.col("entry").isNotNull()
    p = F.when(F.size("param_hits") > 0, F.lit(PARAMETER_SCORE)).otherwise(F.lit(0.0))
    high = _map({k: v[0] for k, v in SINK_SCORES.items()}, F.col("sink"))
    low = _map({k: v[1] for k, v in SINK_SCORES.items()}, F.col("sink"))
    raw = F.when(tainted, F.coalesce(high, p)).otherwise(F.greatest(p, F.coalesce(low, F.lit(0.0))))
    flow = tainted & ~F.col("sink").isin("none", "agent_instruction")
    types = F.array_compact(
        F.array(
            F.when(F.size("param_hits") > 0, "command_injection"),
            F.when(tainted & (F.col("sink") != "none"), "taint_flow"),
        )
    )
    out = joined.withColumn("tainted", tainted).withColumn("raw_score", raw)
    return out.withColumns(
        {
            "risk_score": F.bround("raw_score", 3),
            "threat_level": S.level(F.col("raw_score")),
            "dangerous_flow": flow,
            "threat_types": types,
            "is_safe": ~flow & (F.col("raw_score") < 0.45),
            "source": F.coalesce(F.col("entry.source"), F.lit("none")),
            "path": F.when(tainted, F.concat(F.col("entry.path"), F.array(F.concat(F.lit("tool:"), "tool")))),
            "explanation": explained(tainted),
        }
    ).drop("entry")


def explained(tainted: Column) -> Column:
    """Fixed texts: what a call's score rests on, for a flow, for patterns alone, and for neither."""
    texts = F.array(*[F.lit(f"Dangerous pattern in params: {p[:50]}") for p, _ in PARAMETERS])
    found = F.array_join(F.transform(F.slice("param_hits", 1, 3), lambda i: F.element_at(texts, i)), "; ")
    some = F.size("param_hits") > 0
    flow = F.concat(
        F.lit("Clinejection risk: tainted content from "), "entry.source", F.lit(" flowing into "), "sink", F.lit(" via tool '"), "tool", F.lit("'"),
        F.when(some, F.concat(F.lit(". "), found)).otherwise(""),
    )
    alone = F.concat(F.lit("Dangerous patterns in tool '"), "tool", F.lit("' params: "), found)
    neither = F.concat(F.lit("Tool call '"), "tool", F.lit("' to sink "), "sink", F.lit(" — no taint detected"))
    return F.when(tainted & (F.col("sink") != "none"), flow).when(some, alone).otherwise(neither)

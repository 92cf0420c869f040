"""Checks over streams: the same expressions as in batch, on streaming DataFrames."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guardloom.operators import taint, toolcalls


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the lines of text files that arrive in a folder, as ``body``."""
    return spark.readStream.text(path).select(F.col("value").alias("body"))


def decide_lines(lines: DataFrame, body: str = "body", registry: DataFrame | None = None, key: tuple[str, ...] = ()) -> DataFrame:
    """Decisions on a stream of JSON-RPC lines, one row a request.

    With a ``registry`` (a table of taint entries, a row an id) calls that name its ids have the
    taint check's score; the stream is joined to the table, id by id, and no state is kept."""
    parsed = toolcalls.parse_lines(lines, body)
    if registry is not None:
        parsed = toolcalls.with_taint(parsed, registry, list(key)) if not lines.isStreaming else _stream_taint_score(parsed, registry)
    return toolcalls.decide(parsed)


def _stream_taint_score(parsed: DataFrame, registry: DataFrame) -> DataFrame:
    """taint_score without a join of the stream with itself: the registry as a map from id to
    its place among the entries.  For registries of MOST_ENTRIES at most, which is checked."""
    entries = registry.select("taint_id", "source", "path").limit(taint.MOST_ENTRIES + 1).collect()
    if len(entries) > taint.MOST_ENTRIES:
        raise ValueError(f"a stream's registry holds {taint.MOST_ENTRIES} entries at most")
    kind = "array<struct<taint_id:string,source:string,path:array<string>>>"
    known = F.from_json(F.lit(json.dumps([r.asDict() for r in entries])), kind)
    ids = F.filter(F.coalesce("taint_ids", F.array().cast("array<string>")), lambda i: F.exists(known, lambda e: e["taint_id"] == i))
    entry = F.when(F.size(ids) > 0, F.element_at(F.filter(known, lambda e: e["taint_id"] == F.element_at(ids, 1)), 1))
    named = taint.with_sinks(parsed.withColumn("_text", F.col("taint_text")), "_text").withColumn("entry", entry)
    scored = taint.scored(named).withColumn("taint_score", F.when(F.size("taint_ids") > 0, F.col("risk_score")))
    return scored.select(*parsed.columns, "taint_score")


def route(decided: DataFrame, forward: Callable[[DataFrame], None], refuse: Callable[[DataFrame], None], checkpoint: str, warned: Callable[[DataFrame], None] | None = None, forever: bool = False):
    """Starts a query that hands each micro-batch's rows to two sinks, refused ones with their
    error, and those passed on with a warning to a third, if there is one.  It ends when all that
    is there is done, unless it is to run ``forever``."""

    def batch(df: DataFrame, _: int) -> None:
        df.persist()
        forward(df.where("should_forward"))
        refuse(df.where("NOT should_forward"))
        if warned is not None:
            warned(df.where("warn"))
        df.unpersist()

    writer = decided.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer if forever else writer.trigger(availableNow=True)).start()


def blocked_by_window(decided: DataFrame, ts: str = "ts", late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """An extension: blocked calls in tumbling windows of event time, late rows up to ``late``."""
    marked = decided.withWatermark(ts, late).groupBy(F.window(ts, width))
    return marked.agg(F.count("*").alias("calls"), F.sum(F.col("blocked_call").cast("long")).alias("blocked")).select(
        F.col("window.start").alias("start"), "calls", "blocked"
    )

"""The events table replayed as a stream, until all that is there is done."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guardloom.operators import taint
from guardloom.sources.shared import settle, shared_folder
from guardloom.streaming import registry, stateless

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def replay(spark: SparkSession, rows: DataFrame, work, out: str) -> DataFrame:
    """Writes ``rows`` to a folder, streams them through ``work`` and reads what came out."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows.write.parquet(f"{base}/in")
    stream = work(stateless.read_lines(spark, f"{base}/in", rows.schema.simpleString()[7:-1].replace(":", " ")))
    writer = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").select(*out.split())


def stream_toolcall_decide(spark: SparkSession, d: str) -> DataFrame:
    from guardloom.plans import tool_queries

    lines = tool_queries._lines(spark, d)
    newest = tool_queries._entries(spark, d).orderBy(F.desc("event_id")).limit(taint.MOST_ENTRIES)  # what a registry keeps
    known = settle(newest.select("taint_id", "source", "path"), "stream-registry")
    return replay(spark, lines, lambda s: stateless.decide_lines(s, registry=known, key=("line_id",)), "line_id batch_pos call_risk blocked_call should_forward warn")


def stream_taint(spark: SparkSession, d: str) -> DataFrame:
    """Marks of untrusted content and calls that use them, by user."""
    from guardloom.plans import tool_queries

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        return replay(spark, tool_queries.tracked_events(spark, d), lambda s: registry.track(s, most=tool_queries.TRACKED), "tracker_id seq tool sink tainted source path raw_score")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


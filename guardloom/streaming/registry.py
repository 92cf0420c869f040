"""The taint registry as keyed state: marks, propagations and tool calls in event order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from guardloom.operators import taint

#: kind: mark, propagate, call or clear.  taint_ids: of a call, or the parent of a propagation.
EVENTS = "tracker_id string, seq long, ts timestamp, kind string, taint_id string, source string, surface string, tool string, sink string, param_hit boolean, taint_ids array<string>"
RESULT = "tracker_id string, seq long, tool string, sink string, tainted boolean, source string, path string, raw_score double"


class TaintRegistry(StatefulProcessor):
    """One registry per tracker; the oldest entry goes when there are more than ``most``.

    A micro-batch reads the registry once and writes what changed; in between its entries,
    ``most`` of them at most, are a dictionary in order of time."""

    def __init__(self, most: int = taint.MOST_ENTRIES):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "taint_id string", "source string, path string, ts double, seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = {k[0]: tuple(v) for k, v in self.entries.iterator()}
        held = dict(sorted(before.items(), key=lambda kv: kv[1][2:]))
        out = []
        for r in pd.concat(list(rows)).sort_values(["ts", "seq"]).to_dict("records"):
            if r["kind"] == "clear":
                held.clear()
            elif r["kind"] == "mark":
                self._add(held, r["taint_id"], r["source"], r["surface"], r)
            elif r["kind"] == "propagate":
                parent = self._find(held, r["taint_ids"])
                if parent is not None:
                    self._add(held, r["taint_id"], parent[0], f"{parent[1]}>{r['surface']}", r)
            else:
                out.append(self._score(key[0], r, self._find(held, r["taint_ids"])))
        for k in before.keys() - held.keys():
            self.entries.removeKey((k,))
        for k, v in held.items():
            if before.get(k) != v:
                self.entries.updateValue((k,), v)
        yield pd.DataFrame(out, columns=[x.split()[0] for x in RESULT.split(", ")])

    @staticmethod
    def _find(held, ids):
        return next((held[i] for i in (ids if ids is not None else ()) if i in held), None)

    def _add(self, held, taint_id, source, path, row) -> None:
        new = (source, path, row["ts"].timestamp(), int(row["seq"]))
        late = held and next(reversed(held.values()))[2:] > new[2:]
        held.pop(taint_id, None)
        held[taint_id] = new
        if late:  # an event older than what earlier batches brought
            ordered = sorted(held.items(), key=lambda kv: kv[1][2:])
            held.clear()
            held.update(ordered)
        if len(held) > self.most:
            del held[next(iter(held))]

    @staticmethod
    def _score(tracker, row, entry) -> tuple:
        high, low = taint.SINK_SCORES.get(row["sink"], (None, 0.0))
        p = taint.PARAMETER_SCORE if row["param_hit"] else 0.0
        raw = max(p, low) if entry is None else (p if high is None else high)
        path = None if entry is None else f"{entry[1]}>tool:{row['tool']}"
        return tracker, int(row["seq"]), row["tool"], row["sink"], entry is not None, "none" if entry is None else entry[0], path, float(raw)

    def close(self) -> None:
        pass


def track(events: DataFrame, most: int = taint.MOST_ENTRIES) -> DataFrame:
    """Scores of the calls in a stream of EVENTS.  Needs the RocksDB state store."""
    return events.groupBy("tracker_id").transformWithStateInPandas(
        statefulProcessor=TaintRegistry(most), outputStructType=RESULT, outputMode="Append", timeMode="None"
    )


def call_events(calls: DataFrame) -> DataFrame:
    """Sink and parameter hits of calls (tracker_id, seq, ts, tool, params_text, taint_ids) as EVENTS."""
    hit = taint.parameter_hits(F.coalesce("params_text", F.lit("")))
    last = F.element_at(F.array(*[F.lit(s) for _, s in taint.PARAMETERS]), F.element_at("hits", -1))
    scanned = calls.withColumn("hits", hit)
    sink = F.coalesce(taint.sink_of_tool(F.col("tool")), F.when(F.size("hits") > 0, last), F.lit("none"))
    none = F.lit(None).cast("string")
    return scanned.select(
        "tracker_id", "seq", "ts", F.lit("call").alias("kind"), none.alias("taint_id"), none.alias("source"), none.alias("surface"),
        "tool", sink.alias("sink"), (F.size("hits") > 0).alias("param_hit"), "taint_ids",
    )

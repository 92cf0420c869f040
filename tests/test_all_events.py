"""Taint queries look at every event."""

from guardloom.operators import taint
from guardloom.plans import tool_queries as queries
from guardloom.plans.fixtures import pick
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def ids(df, name="event_id"):
    return sorted(r[0] for r in df.select(name).collect())


def test_every_event_is_marked_or_trusted(spark):
    events = queries._events(spark, SF).withColumn("surface", pick(queries.MARK_SURFACES, queries._key(3)))
    untrusted = events.where(taint.source_of(F.col("surface")).isNotNull())
    assert ids(queries.taint_mark(spark, SF)) == ids(untrusted)
    assert {i % 3 for i in ids(queries.taint_evict(spark, SF))} == {0, 1, 2}


def test_every_event_has_a_role(spark):
    tracked = queries.tracked_events(spark, SF)
    assert ids(tracked, "seq") == ids(queries._events(spark, SF))
    assert {r[0] for r in tracked.select("kind").distinct().collect()} == {"mark", "propagate", "call"}

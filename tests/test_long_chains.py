"""Propagation over long chains, cycles and many entries."""

from guardloom.operators import taint
from pyspark.sql import functions as F

ENTRY = "taint_id string, content_hash string, source string, path array<string>"
EDGE = "parent_id string, child_id string, next_surface string"


def propagated(spark, edges, roots=("n0",)):
    entries = spark.createDataFrame([(r, "h", "email", ["email"]) for r in roots], ENTRY)
    return taint.propagate(entries, spark.createDataFrame([(a, b, "x") for a, b in edges], EDGE))


def test_chains_are_followed_to_their_end(spark):
    got = propagated(spark, [(f"n{i}", f"n{i + 1}") for i in range(300)]).collect()
    assert sorted(r["depth"] for r in got) == list(range(301))
    assert all(len(r["path"]) == r["depth"] + 1 and r["source"] == "email" for r in got)


def test_hashes_are_those_of_one_step_after_another(spark):
    import hashlib

    want = "h"
    for _ in range(5):
        want = hashlib.sha256((want + "x").encode()).hexdigest()[:16]
    got = propagated(spark, [(f"n{i}", f"n{i + 1}") for i in range(5)]).where("depth = 5").first()
    assert got["content_hash"] == want


def test_cycles_derive_nothing_new(spark):
    edges = [("n0", "n1"), ("n1", "n2"), ("n2", "n0"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "tail"), ("self", "self")]
    assert {(r["taint_id"], r["depth"]) for r in propagated(spark, edges).collect()} == {("n0", 0), ("n1", 1), ("n2", 2)}


def test_an_id_is_made_once(spark):
    got = propagated(spark, [("n0", "d"), ("m0", "d"), ("m0", "d"), ("d", "e"), ("n0", "m0")], roots=("n0", "m0")).collect()
    assert sorted((r["taint_id"], r["depth"]) for r in got) == [("d", 1), ("e", 2), ("m0", 0), ("n0", 0)]


def test_nulls_and_empty_tables(spark):
    assert propagated(spark, []).count() == 1 and propagated(spark, [("n0", "n1")], roots=()).count() == 0
    assert propagated(spark, [("n0", None), (None, "n1")]).count() == 1


def test_two_million_entries(spark):
    n = 1_000_000
    rows = spark.range(n).select(F.concat(F.lit("r"), "id").alias("taint_id"), F.lit("h").alias("content_hash"), F.lit("email").alias("source"), F.array(F.lit("email")).alias("path"))
    edges = rows.select(F.col("taint_id").alias("parent_id"), F.concat("taint_id", F.lit("x")).alias("child_id"), F.lit("x").alias("next_surface"))
    assert taint.propagate(rows, edges).count() == 2 * n

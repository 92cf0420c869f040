"""Connected components by alternating large-star and small-star rounds.

All rounds are joins and aggregations over the edges; each is written to the shared
folder and reread.  Nothing is gathered on the driver but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardloom.llm.common import materialise, release


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Edges (u, v) of comparable ids -> (node, root): every node of an edge and the
    smallest node that it can reach.  Repeated edges and loops do no harm.  Rounds grow with the
    logarithm of the longest path; more than ``most_rounds`` are an error, never a cut."""
    now = materialise(edges.where("u <> v").select("u", "v").distinct(), "cc")
    seen = None
    for _ in range(most_rounds):
        before, now = now, materialise(_small_star(_large_star(now)), "cc")
        release(before)
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen:
            root = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return root.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = mark
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")

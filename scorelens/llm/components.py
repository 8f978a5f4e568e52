"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum (combined before the shuffle) and a join back, so a
vertex with many links is never gathered in one task; each round's edges are written
to the shared folder, which cuts the lineage.  Nothing but a count and a checksum of
the edges reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checksum, stage


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.where("v > u").join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return (moved.unionByName(least.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(u, v)`` links to ``(u, root)``: one row per vertex that is not its own root,
    ``root`` the smallest vertex it reaches.  Self links and repeated links are ignored;
    no links give no rows."""
    cur = stage(edges.select("u", "v").where("u <> v").distinct(), "cc")
    seen = checksum(cur)
    if seen[0]:
        for _ in range(max_rounds):
            cur = stage(_small_star(_large_star(cur)), "cc")
            now = checksum(cur)
            if now == seen:
                break
            seen = now
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return cur.select("u", F.col("v").alias("root"))

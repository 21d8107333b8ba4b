"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import checkpoint, forget, spread_join


def components(edges: DataFrame) -> DataFrame:
    """(id, component): for every id in ``edges`` (u, v), the smallest id that it reaches.

    Alternating large-star and small-star steps: every node passes its smallest neighbour on to
    the larger ones, then to the smaller ones, until each component is a star around its
    smallest id. Steps are partial minima and joins in which the edges of a hub are dealt over
    many keys, so no neighbourhood is gathered in one place; every step's edges are
    written once and those before them deleted.
    """

    def passed(pairs: DataFrame) -> DataFrame:
        """Each edge with the smallest neighbour m of its u."""
        least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        return spread_join(pairs, least.select("u", F.least("u", "m").alias("m")), "u", "v", least)

    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = checkpoint(now)
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = passed(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = passed(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        last, now = now, checkpoint(small.where("u <> v").distinct())
        forget(last)
        after = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())

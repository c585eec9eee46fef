"""Connected components of links by joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from runquarry.llm.common import fixed


def connected(links: DataFrame, left: str, right: str) -> DataFrame:
    """(id, component) of every id that a link names: the smallest id reachable.

    Alternates two steps until nothing changes: every id hangs its larger neighbours on the smallest id around
    it, then itself and its smaller neighbours. Minima are partial aggregates and edges are joined, so an id with
    very many links is never gathered in one place. Each round is written to the shared folder, which cuts lineage.
    """
    u, v = F.greatest(left, right), F.least(left, right)
    edges = fixed(links.select(u.alias("u"), v.alias("v")).where("u > v").distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        up = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = up.groupBy("u").agg(F.min("v").alias("m"))
        down = up.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        edges = fixed(down.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        state = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if before == (state["n"], state["h"]):
            break
        before = state["n"], state["h"]
    roots = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return roots.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())

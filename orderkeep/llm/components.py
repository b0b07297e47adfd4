"""Connected components by alternating large-star and small-star rounds of Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderkeep.session import cut


def components(edges: DataFrame) -> DataFrame:
    """(v, root): for each end of an edge (a long, b long) the smallest vertex that it reaches.

    Each round shuffles edges only; a vertex's smallest neighbour is found by an aggregate with map-side partial results and
    joined back; that table is checkpointed, so that Spark can split the rows of a vertex of many edges in the join. Loops are ignored; no edges give no rows."""
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == before or not state["n"]:
            break
        before = state
        # large star: larger neighbours go to the smallest of the neighbourhood
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        e = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: smaller neighbours and the vertex itself go to the smallest
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        e = cut(e)
    found = e.select(F.col("u").alias("v"), F.col("v").alias("root"))
    return found.unionByName(e.select(F.col("v"), F.col("v").alias("root")).distinct())

"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (x, y bigint): root is the smallest node of its component.

    Stars are made larger and smaller by turns: every node passes its smallest neighbour to its
    other neighbours, until nothing changes. Minima are taken before the shuffle and a hub's edges
    stay rows of a join, so no neighbourhood is ever in one place. Edges with a null end and loops
    count for nothing; repeated edges count once; no edges give no rows.
    """
    now = checkpointed(edges.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).where("x is not null and y is not null and x != y").distinct(), small=True)
    before = None
    while True:
        both = now.union(now.select("y", "x"))
        least = both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("m"))
        wide = both.join(least, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).union(least.where("m < x").select("x", F.col("m").alias("y")))
        wide = wide.where("x > y").distinct()
        below = wide.groupBy("x").agg(F.min("y").alias("m"))
        narrow = wide.join(below, "x").select(F.when(F.col("y") == F.col("m"), F.col("x")).otherwise(F.col("y")).alias("x"), F.col("m").alias("y"))
        now = checkpointed(narrow.where("x > y").distinct(), small=True)
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    return now.select(F.col("x").alias("node"), F.col("y").alias("root")).union(now.select("y", "y").distinct())

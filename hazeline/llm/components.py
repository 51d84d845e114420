"""Connected components of a link table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for every id of ``edges (a, b)``: component is the smallest id that links reach.

    Each round hangs every vertex under its smallest neighbour if that is smaller, shortens the paths to the roots,
    and keeps the links between different roots only.  Links to self, repeated links and nulls do no harm.
    """
    live = stored(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    ids = live.select(F.col("a").alias("id")).union(live.select("b")).distinct()
    at = None
    while not live.isEmpty():
        hung = stored(live.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("root")))
        while True:
            up = hung.select(F.col("v").alias("root"), F.col("root").alias("above"))
            nxt = stored(hung.join(up, "root", "left").select("v", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
            hung = nxt.select("v", "root")
            if nxt.filter("moved").isEmpty():
                break
        for c in ("a", "b"):
            live = live.join(hung.withColumnRenamed("v", c), c, "left").withColumn(c, F.coalesce("root", c)).drop("root")
        live = stored(live.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        if at is None:
            at = hung.withColumnRenamed("v", "id")
        else:
            far = hung.select(F.col("v").alias("root"), F.col("root").alias("above"))
            moved = at.join(far, "root", "left").select("id", F.coalesce("above", "root").alias("root"))
            fresh = hung.select(F.col("v").alias("id"), "root").join(at, "id", "left_anti")
            at = stored(moved.unionByName(fresh))
    if at is None:
        return ids.select("id", F.col("id").alias("component"))
    return ids.join(at, "id", "left").select("id", F.coalesce("root", "id").alias("component"))

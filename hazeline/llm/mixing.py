"""Mixing sources to target weights, over a tree such as domain, language, source.

A token budget is divided from the root down by the weights of siblings.  A node cannot take more than its documents
hold over all epochs; what it leaves goes to its siblings, and to relatives farther up only when no sibling can take
it.  Each leaf then takes whole epochs and a token prefix of one more, every epoch in a seeded order of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazeline.llm.common import stored


def weight_of(column: str, weights: dict[str, float]) -> Column:
    """Weight of a node by its name; names that are not listed weigh 1."""
    out = F.lit(1.0)
    for name, w in weights.items():
        out = F.when(F.col(column) == name, float(w)).otherwise(out)
    return out


def divided(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Adds ``given`` to ``nodes (.., capacity, weight, budget)``: the parents' budgets poured over siblings.

    Siblings are filled in the order of capacity per weight; the level is where the rest meets the first that is not full.
    """
    live = F.col("weight") > 0
    fill = F.when(live, F.col("capacity") / F.col("weight"))
    w = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    ordered = w.orderBy(fill.asc_nulls_last(), *[c for c in nodes.columns if c not in ("capacity", "weight", "budget")])
    before = F.coalesce(F.sum(F.when(live, F.col("capacity"))).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weight = F.sum(F.when(live, F.col("weight"))).over(ordered.rowsBetween(0, Window.unboundedFollowing))
    nodes = nodes.withColumn("_level", F.when(live, (F.col("budget") - before) / weight)).withColumn("_fill", fill)
    open_ = F.when(F.col("_fill") > F.col("_level"), F.col("_level"))
    nodes = nodes.withColumn("_water", F.max(open_).over(w))
    given = F.when(~live, 0.0).when(F.col("_water").isNull(), F.col("capacity").cast("double")).otherwise(
        F.least(F.col("capacity").cast("double"), F.col("_water") * F.col("weight")))
    return nodes.withColumn("given", given).drop("_level", "_fill", "_water")


def quotas(leaves: DataFrame, tree: list[str], weights: list[dict[str, float]], budget: int | None, share: float, epochs: int) -> DataFrame:
    """``leaves (tree.., total)`` with ``quota``: whole tokens for each leaf."""
    held = leaves.withColumn("capacity", F.col("total") * epochs)
    whole = held.agg(F.coalesce(F.sum("capacity"), F.lit(0)).alias("capacity"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"))
    wanted = F.lit(float(budget)) if budget is not None else F.floor(F.col("total") * F.lit(share)).cast("double")
    top = whole.select(F.least(wanted, F.col("capacity").cast("double")).alias("budget"), F.lit(0).alias("_root"))
    above, joined = top, ["_root"]
    held = held.withColumn("_root", F.lit(0))
    for depth, name in enumerate(tree):
        path = ["_root", *tree[: depth + 1]]
        nodes = held.groupBy(*path).agg(F.sum("capacity").alias("capacity")).withColumn("weight", weight_of(name, weights[depth]))
        nodes = divided(nodes.join(above, joined), joined)
        above, joined = nodes.select(*path, F.col("given").alias("budget")), path
    return held.join(above, joined).select(*tree, "total", F.floor("budget").cast("bigint").alias("quota"))


def mixed(df: DataFrame, tree: list[str], weights: list[dict[str, float]], tokens: str, key: str, budget: int | None = None,
          share: float = 0.5, epochs: int = 1, seed: int = 17) -> DataFrame:
    """The chosen rows of ``df``, once per epoch they are chosen in, with ``epoch`` (from 0).

    ``budget`` is in tokens; without it, ``share`` of all tokens.  A leaf's prefix holds the documents whose running sum
    of tokens stays within its quota.  Null tree values make a node named "none"; null token counts are 0; rows with
    equal keys are ordered by their token counts.  An empty table gives an empty result.  A column ``epoch`` is replaced.
    """
    named = [f"_t{i}" for i in range(len(tree))]
    rows = df.withColumns({n: F.coalesce(F.col(c).cast("string"), F.lit("none")) for n, c in zip(named, tree)})
    rows = rows.withColumn("_n", F.coalesce(F.col(tokens).cast("bigint"), F.lit(0)))
    leaves = rows.groupBy(*named).agg(F.sum("_n").alias("total"), F.count("*").alias("_rows"))
    leaves = stored(leaves)
    size = leaves.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    aims = quotas(leaves.drop("_rows"), named, weights, budget, share, epochs)
    full = F.when(F.col("total") > 0, F.floor(F.col("quota") / F.col("total"))).otherwise(0).cast("int")
    aims = stored(aims.withColumn("_full", full).withColumn("_rest", F.col("quota") - F.col("_full") * F.col("total")))
    # buckets of some thousand rows by the first hex digits of the order, whatever the size of a leaf
    digits = 1
    while 16**digits * 1000 < size:
        digits += 1
    placed = rows.join(aims.drop("total", "quota"), named).withColumn(
        "_order", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_full").cast("string"), F.col(key).cast("string"))))
    placed = placed.withColumn("_bucket", F.substring("_order", 1, digits))
    sums = placed.groupBy(*named, "_bucket", "_rest").agg(F.sum("_n").alias("own"))
    upto = F.sum("own").over(Window.partitionBy(*named).orderBy("_bucket"))
    edge = sums.withColumn("upto", upto).filter(F.col("upto") > F.col("_rest")).groupBy(*named).agg(
        F.min(F.struct("_bucket", (F.col("upto") - F.col("own")).alias("before"))).alias("edge"))
    edges = stored(edge.select(*named, F.col("edge._bucket").alias("_edge"), F.col("edge.before").alias("_before")))
    cut = placed.join(edges, named, "left")
    inner = cut.filter(F.col("_bucket") == F.col("_edge"))
    run = F.sum("_n").over(Window.partitionBy(*named).orderBy("_order", key, "_n").rowsBetween(Window.unboundedPreceding, 0))
    inner = inner.withColumn("_part", F.col("_before") + run <= F.col("_rest"))
    outer = cut.filter(F.col("_edge").isNull() | (F.col("_bucket") != F.col("_edge"))).withColumn(
        "_part", F.col("_edge").isNull() | (F.col("_bucket") < F.col("_edge")))
    out = outer.unionByName(inner)
    last = F.when(F.col("_part") & (F.col("_full") < epochs), F.col("_full")).otherwise(F.col("_full") - 1)
    chosen = out.filter(last >= 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), last)))
    return chosen.select(*[c for c in df.columns if c != "epoch"], "epoch")

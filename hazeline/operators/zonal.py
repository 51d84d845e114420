"""Polygon x grid overlay with exact coverage fractions, and coverage-weighted zonal statistics.

Polygons are edge tables (polygon key, ring_id, ax, ay, bx, by) in lon/lat; ring 0 is the outer ring, other rings
are holes.  Rings may be drawn in either direction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazeline.operators.loops import checkpointed

_EXACT = "decimal(38,18)"


def ring_edges(rings: DataFrame, keys: Sequence[str], points: str = "points") -> DataFrame:
    """Closed rings as vertex arrays (structs x, y) to directed edges."""
    nxt = F.concat(F.slice(points, 2, F.size(points) - 1), F.slice(points, 1, 1))
    pair = F.explode(F.arrays_zip(F.col(points).alias("a"), nxt.alias("b"))).alias("e")
    return rings.select(*keys, "ring_id", pair).select(
        *keys, "ring_id", *[F.col(f"e.{p}.{c}").alias(f"{p}{c}") for p in "ab" for c in "xy"]
    )


def _antiderivative(u: Column) -> Column:
    """Integral of clamp(u, 0, 1)."""
    return F.when(u <= 0, F.lit(0.0)).when(u < 1, u * u / 2).otherwise(u - 0.5)


def coverage(
    edges: DataFrame, polygon: str, *, x0: float = 0.0, y0: float = 0.0, dx: float = 1.0, dy: float = 1.0
) -> DataFrame:
    """Covered fraction of every grid cell a polygon touches: (polygon, cell_x, cell_y, cov).

    An edge is walked through the cells it crosses and no others.  In each it leaves the signed area below it, and per
    grid column one carry: its signed width, which counts for every cell further down.  A running sum down the column adds
    the carries up, and the cells between two crossed ones, all alike, are listed from it only where they are covered.
    Rows made: crossed cells, one carry per edge and column, covered cells.  Edges are independent rows and are added up
    before the exchange, so a polygon with very many of them spreads over all tasks.  A ring's own cells all carry the sign
    of its direction, hence ``abs`` makes the drawing direction irrelevant.
    """
    ring = ring_columns(edges, polygon, x0=x0, y0=y0, dx=dx, dy=dy)
    down = Window.partitionBy(polygon, "ring_id", "cell_x").orderBy(F.desc("cell_y"))
    so_far = F.sum("carry").over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    walked = ring.withColumns({"_full": so_far, "_next": F.lead("cell_y").over(down)})
    # What stands below a crossed cell until the next one; the rest of a closed ring's sum is rounding.
    empty = F.abs("_full") <= 1e-9
    rows = F.when(empty | F.col("_next").isNull(), F.array("cell_y")).otherwise(F.sequence(F.col("_next") + 1, F.col("cell_y")))
    cells = walked.withColumn("_row", F.explode(rows))
    own = F.when(F.col("_row") == F.col("cell_y"), F.col("part")).otherwise(0.0) + F.col("_full")
    signed = cells.select(polygon, "cell_x", F.col("_row").alias("cell_y"), F.when(F.col("ring_id") == 0, F.abs(own)).otherwise(-F.abs(own)).alias("_c"))
    return signed.groupBy(polygon, "cell_x", "cell_y").agg(F.sum("_c").alias("cov")).filter(F.col("cov") > 1e-9)


def ring_columns(edges: DataFrame, polygon: str, *, x0: float, y0: float, dx: float, dy: float) -> DataFrame:
    """Per ring, grid column and row that an edge crosses or hands a carry to: signed area ``part`` of the edges crossing
    the cell, and the ``carry`` that counts from this row down."""
    g = edges.select(
        polygon, "ring_id",
        *[((F.col(c) - F.lit(o)) / F.lit(s)).alias(c)
          for c, o, s in (("ax", x0, dx), ("ay", y0, dy), ("bx", x0, dx), ("by", y0, dy))],
    ).filter(F.col("ax") != F.col("bx"))
    left, right = F.least("ax", "bx"), F.greatest("ax", "bx")
    g = g.withColumn("cell_x", F.explode(F.sequence(F.floor(left), F.ceil(right) - 1)))
    g = g.withColumns({
        "_x1": F.greatest(left, F.col("cell_x").cast("double")),
        "_x2": F.least(right, (F.col("cell_x") + 1).cast("double")),
        "_slope": (F.col("by") - F.col("ay")) / (F.col("bx") - F.col("ax")),
    }).filter(F.col("_x2") > F.col("_x1"))
    g = g.withColumns({f"_y{i}": F.col("ay") + F.col("_slope") * (F.col(f"_x{i}") - F.col("ax")) for i in (1, 2)})
    low, high = F.floor(F.least("_y1", "_y2")), F.floor(F.greatest("_y1", "_y2"))
    g = g.withColumns({"_low": low, "cell_y": F.explode(F.sequence(low - 1, high))})
    u1, u2 = F.col("_y1") - F.col("cell_y"), F.col("_y2") - F.col("cell_y")
    flat = F.greatest(F.lit(0.0), F.least(F.lit(1.0), u1))
    height = F.when(F.abs(u2 - u1) < 1e-12, flat).otherwise(
        (_antiderivative(u2) - _antiderivative(u1)) / F.when(F.abs(u2 - u1) < 1e-12, F.lit(1.0)).otherwise(u2 - u1)
    )
    width = F.signum(F.col("bx") - F.col("ax")) * (F.col("_x2") - F.col("_x1"))
    below = F.col("cell_y") < F.col("_low")
    return g.groupBy(polygon, "ring_id", "cell_x", "cell_y").agg(
        F.sum(F.when(below, 0.0).otherwise(width * height)).alias("part"), F.sum(F.when(below, width).otherwise(0.0)).alias("carry"))


def weighted_summary(
    df: DataFrame, keys: Sequence[str], value: str, weight: str, *, digits: int = 18, pivots: int = 128, rounds: int = 2
) -> DataFrame:
    """Weighted mean, lower weighted median and maximum per group: (keys, mean, median, max).

    The lower median is the smallest value whose cumulative weight reaches half the total.  Weights count to
    ``digits`` decimals there, exactly, so sums do not depend on order; a group's total may reach 1e20.  Equal values of a group are added up
    first.  The median is then selected in rounds: a sketch of the group's values gives ``pivots`` of them, the exact
    weights between pivots tell which piece holds it, and only that piece goes on.  After ``rounds`` rounds a
    ``pivots ** rounds``-th of a group's distinct values (about, the sketch being rough to 1 in 10,000) is put in order in
    one task.  Pivots are values of the group, so outliers do not matter.  Groups without a known value, or without
    weight, give no row; null weights count as 0.
    """
    w = F.round(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), digits).cast(_EXACT)
    known = df.filter(F.col(value).isNotNull())
    rows = known.select(*keys, F.col(value).cast("double").alias("_v"), w.alias("_w"), F.coalesce(F.col(weight), F.lit(0.0)).alias("_c"))
    # Read several times below, so written down: the overlay runs once, and all reads see the same sums.
    atoms = checkpointed(rows.groupBy(*keys, "_v").agg(F.sum("_w").cast(_EXACT).alias("_w"), F.sum("_c").alias("_c")))
    totals = atoms.groupBy(*keys).agg(
        F.sum("_w").cast(_EXACT).alias("_total"), (F.sum(F.col("_v") * F.col("_c")) / F.sum("_c")).alias("mean"), F.max("_v").alias("max"))
    # Per group: the interval (_above, _upto] that holds the median, and the weight at or below _above (null: no bound).
    found = totals.filter("_total > 0").withColumns({"_above": F.lit(None).cast("double"), "_upto": F.col("max"), "_before": F.lit(0).cast(_EXACT)})
    for _ in range(rounds):
        found = _narrowed(atoms, found, keys, pivots)
    inside = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = _held(atoms, found, keys).withColumn("_cum", F.col("_before") + F.sum("_w").over(inside))
    half = F.when(2 * F.col("_cum") >= F.col("_total"), F.col("_v"))
    return hit.groupBy(*keys).agg(F.first("mean").alias("mean"), F.min(half).alias("median"), F.first("max").alias("max"))


def _held(atoms: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The values still in question, beside their group's interval."""
    return atoms.select(*keys, "_v", "_w").join(found, list(keys)).filter(
        (F.col("_above").isNull() | (F.col("_v") > F.col("_above"))) & (F.col("_v") <= F.col("_upto")))


def _narrowed(atoms: DataFrame, found: DataFrame, keys: Sequence[str], pivots: int) -> DataFrame:
    """One round of selection: the interval of every group shrunk to one piece between pivots."""
    held = _held(atoms, found, keys)
    shares = [i / pivots for i in range(1, pivots + 1)]
    cuts = held.groupBy(*keys).agg(F.array_distinct(F.percentile_approx("_v", shares, 10_000)).alias("_cuts"))
    piece = F.aggregate("_cuts", F.lit(0), lambda n, c: n + (c < F.col("_v")).cast("int"))
    sums = held.join(cuts, list(keys)).withColumn("_piece", piece).groupBy(*keys, "_piece").agg(
        F.sum("_w").cast(_EXACT).alias("_own"), F.max("_v").alias("_top"), F.first("_before").alias("_before"), F.first("_total").alias("_total"),
        F.first("mean").alias("mean"), F.first("max").alias("max"), F.first("_above").alias("_above"))
    order = Window.partitionBy(*keys).orderBy("_piece")
    run = F.sum("_own").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = sums.withColumns({"_cum": F.col("_before") + run, "_under": F.lag("_top").over(order)})
    holds = (2 * F.col("_cum") >= F.col("_total")) & (2 * (F.col("_cum") - F.col("_own")) < F.col("_total"))
    return checkpointed(ranked.filter(holds).select(
        *keys, "_total", "mean", "max", F.coalesce("_under", "_above").alias("_above"), F.col("_top").alias("_upto"),
        (F.col("_cum") - F.col("_own")).cast(_EXACT).alias("_before")))


def zonal_stats(
    grid: DataFrame, cover: DataFrame, polygon: str, date: str = "date",
    functions: Sequence[str] = ("mean", "median", "max"),
) -> DataFrame:
    """Coverage-weighted statistics per polygon and day, long: (polygon, date, fun, value).

    The median weighs coverage in billionths, below which it is rounding of the overlay.
    """
    keys = [polygon, date]
    cells = grid.filter(F.col("value").isNotNull()).join(cover, ["cell_x", "cell_y"])
    if "median" in functions:
        wide = weighted_summary(cells, keys, "value", "cov", digits=9)
    else:
        mean = F.sum(F.col("value") * F.col("cov")) / F.sum("cov")
        wide = cells.groupBy(*keys).agg(mean.alias("mean"), F.max("value").alias("max"))
    return wide.unpivot(keys, list(functions), "fun", "value")


def zone_means(stats: DataFrame, polygons: DataFrame, polygon: str, zone_keys: Sequence[str]) -> DataFrame:
    """Several polygons of one zone averaged, unweighted, per statistic and day."""
    named = stats.join(polygons.select(polygon, *zone_keys), polygon)
    return named.groupBy(*zone_keys, "fun", "date").agg(F.avg("value").alias("value"))

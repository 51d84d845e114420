"""Dense zone x period grids, and the windows that need them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazeline.functions.nulls import fill_null
from hazeline.operators.loops import checkpointed


def complete(df: DataFrame, keys: Sequence[str], axis: str, values: Column, fill: dict | None = None) -> DataFrame:
    """Every combination of the observed ``keys`` with ``values`` appears at least once.

    Rows off the axis, rows with a NULL axis and repeated rows are kept.  ``fill`` also replaces NULLs that
    were there before.  ``df`` itself is not shuffled: only its distinct (keys, axis) pairs are, which Spark
    reduces before the exchange, so a zone holding a large share of the rows costs nothing extra.
    """
    grid = df.select(*keys).distinct().withColumn("_v", F.explode(values))
    grid = grid.withColumn(axis, F.col("_v").cast(df.schema[axis].dataType)).drop("_v")
    present = df.select(*keys, axis).filter(F.col(axis).isNotNull()).distinct()
    same = [grid[k].eqNullSafe(present[k]) for k in keys] + [grid[axis] == present[axis]]
    absent = grid.join(present, same, "left_anti")
    out = df.unionByName(absent, allowMissingColumns=True).select(*df.columns)
    return fill_null(out, fill) if fill else out


def aggregate_on_grid(
    df: DataFrame,
    keys: Sequence[str],
    axis: str,
    values: Column,
    aggs: dict[str, Column],
    fill: dict | None = None,
    only_if: Column | None = None,
) -> DataFrame:
    """Aggregate by (keys, axis), then complete each key over ``values``; one row per cell.

    The input is read once and shuffled once, after partial aggregation.  The second exchange carries only
    aggregated cells, and the absent ones are made inside each key, without a join.  A key's cell list holds
    each axis value once (the rows are already grouped), so its size is bounded by the calendar and not by
    the data.  The result stays partitioned by ``keys``: windows and roll-ups per zone need no exchange.

    ``only_if`` is an aggregate over a key's cells; keys where it is not TRUE are left as they are.
    """
    fill = fill or {}
    cells = df.groupBy(*keys, axis).agg(*[c.alias(n) for n, c in aggs.items()])
    kind = {f.name: f.dataType for f in cells.schema}
    gate = [] if only_if is None else [F.coalesce(only_if, F.lit(False)).alias("_wanted")]
    per_key = cells.groupBy(*keys).agg(F.collect_list(F.struct(axis, *aggs)).alias("_cells"), *gate)
    axis_values = F.transform(values, lambda v: v.cast(kind[axis])) if _is_number(kind[axis]) else values
    absent = F.array_except(axis_values, F.transform("_cells", lambda c: c[axis]))
    if only_if is not None:
        absent = F.slice(absent, 1, F.when(F.col("_wanted"), F.size(axis_values)).otherwise(0))

    def empty_cell(v: Column) -> Column:
        return F.struct(v.alias(axis), *[F.lit(fill.get(n)).cast(kind[n]).alias(n) for n in aggs])

    dense = per_key.withColumn("_absent", absent).select(
        *keys, F.inline(F.concat("_cells", F.transform("_absent", empty_cell)))
    )
    return fill_null(dense, fill) if fill else dense


def _is_number(kind) -> bool:
    return kind.typeName() in ("integer", "long", "short", "byte")


def observed_range(df: DataFrame, date: str, most_days: int = 36_600) -> Column:
    """Day axis between the first and the last observed date, as lazy scalars.

    One wild date would stretch every zone's axis, so a span of more than ``most_days`` fails when it is read.
    """
    ends = df.agg(F.min(date).alias("lo"), F.max(date).alias("hi"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    far = F.raise_error(F.concat(F.lit(f"{date} spans more than {most_days} days: "), lo.cast("string"), F.lit(" to "), hi.cast("string")))
    return F.sequence(lo, F.when(F.datediff(hi, lo) > most_days, far.cast("date")).otherwise(hi))


def fill_down(df: DataFrame, zone: str, order: str, columns: Sequence[str]) -> DataFrame:
    """Last non-NULL value so far, per zone.  On a dense grid a zone's frame is one calendar long."""
    so_far = Window.partitionBy(zone).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(so_far) for c in columns})


def increments(df: DataFrame, zone: str, order: str, columns: dict[str, str]) -> DataFrame:
    """``columns``: cumulative column -> name of its difference to the previous period of the zone."""
    previous = Window.partitionBy(zone).orderBy(order)
    return df.withColumns({out: F.col(c) - F.lag(c).over(previous) for c, out in columns.items()})


def surrogate_id(zones: DataFrame, key: str, name: str = "zone_id") -> DataFrame:
    """Consecutive ids 1..n in the order of a unique ``key``, without sorting all zones in one task.

    Rows are dealt into ranges of the key and sorted there, and written down, so that both uses see the same ranges.
    Numbers inside a range start where the ranges before it end; only one count per range visits the driver.
    """
    dealt = zones.repartitionByRange(key).sortWithinPartitions(key)
    # The number Spark gives a row holds its partition in the upper 31 bits and its place there in the lower 33.
    numbered = checkpointed(dealt.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = sorted((r["part"], r["count"]) for r in numbered.groupBy(part.alias("part")).count().collect())
    before, total = [], 0
    for p, n in sizes:
        before.append((p, total))
        total += n
    offsets = zones.sparkSession.createDataFrame(before, "_part long, _before long")
    placed = numbered.withColumn("_part", part).join(offsets, "_part")
    place = F.col("_at") - F.shiftleft(F.col("_part"), 33)
    return placed.withColumn(name, F.col("_before") + place + 1).drop("_at", "_part", "_before")

"""Zone-month features and the joined base panel."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazeline.functions.dates import lagged, parse_ymd
from hazeline.functions.nulls import clamp_negative, fill_null, in_set, replace_zero
from hazeline.functions.text import leading_number, name_key
from hazeline.operators.grid_fill import aggregate_on_grid, fill_down, increments


def last_in_period(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Value of the newest row per group, by a real ordering; NULL if the newest value is NULL."""
    return df.groupBy(*keys).agg(*[F.max_by(v, F.struct(*order)).alias(v) for v in values])


def counter_rows(counter: DataFrame, date: str, *, first: str, last: str, period: Column, lag_days: int = 14) -> DataFrame:
    """Counter rows moved back by the reporting lag and kept inside [first, last], with their ``period``."""
    shifted = counter.withColumn(date, lagged(date, lag_days)).filter(
        F.col(date).between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    )
    return shifted.withColumn("period", period)


def stepped(dense: DataFrame, zone: str, period: str, values: Sequence[str], reset_first: int | None) -> DataFrame:
    """``<v>_total`` carried over empty periods of a dense grid, and its increments ``<v>_new``."""
    totals = [f"{v}_total" for v in values]
    if reset_first is not None:
        at_start = F.col(period) == reset_first
        dense = dense.withColumns({c: F.when(at_start, F.lit(0)).otherwise(F.col(c)) for c in totals})
    filled = fill_down(dense, zone, period, totals)
    new = {f"{v}_total": f"{v}_new" for v in values}
    steps = increments(filled, zone, period, new)
    return steps.withColumns({c: clamp_negative(F.coalesce(F.col(c), F.lit(0))) for c in new.values()})


def counter_increments(
    counter: DataFrame, zone: str, date: str, values: Sequence[str], *,
    first: str, last: str, period: Column, axis: Column, order: Sequence[str] | None = None,
    lag_days: int = 14, reset_first: int | None = 1,
) -> DataFrame:
    """Cumulative counters to per-period cumulative and increment columns (``<v>_total``, ``<v>_new``).

    Dates are moved back by the reporting lag and kept inside [first, last]; the last value per zone and
    ``period`` is carried over empty periods.  Period ``reset_first`` is forced to 0 (None: leave it);
    a falling counter gives an increment of 0.
    """
    order = list(order or [date])
    shifted = counter_rows(counter, date, first=first, last=last, period=period, lag_days=lag_days)
    newest = {f"{v}_total": F.max_by(v, F.struct(*order)) for v in values}
    dense = aggregate_on_grid(shifted, [zone], "period", axis, newest)
    return stepped(dense, zone, "period", values, reset_first)


def complete_months(df: DataFrame, zone: str, month: str, axis: Column, sums: Sequence[str]) -> DataFrame:
    """Monthly sums per known zone, zero-filled over ``axis``."""
    known = df.filter(F.col(zone).isNotNull())
    return aggregate_on_grid(known, [zone], month, axis, {c: F.sum(c) for c in sums}, dict.fromkeys(sums, 0))


def area_by_name(
    cuts: DataFrame, names: DataFrame, *, name: str, state: str, month: str, axis: Column, area: str, zone: str
) -> DataFrame:
    """Areas reported under free-text names, summed, completed and resolved to zone codes.

    Names are folded before grouping, so two spellings of one place add up.  Unknown names drop out.
    ``names`` holds (zone, name, state).
    """
    folded = cuts.withColumn(name, name_key(name))
    dense = aggregate_on_grid(folded, [name, state], month, axis, {area: F.sum(area)}, {area: 0})
    known = names.select(zone, name_key(name).alias(name), state)
    return dense.join(known, [name, state]).select(zone, month, area)


def areas_by_zone(cuts: DataFrame, names: DataFrame, *, name: str, state: str, period: str, area: str, zone: str) -> DataFrame:
    """Areas reported under free-text names, added up and resolved to (zone, period, area); only reported periods."""
    folded = cuts.withColumn(name, name_key(name)).groupBy(name, state, period).agg(F.sum(area).alias(area))
    return folded.join(names.select(zone, name_key(name).alias(name), state), [name, state]).select(zone, period, area)


def join_on_name(left: DataFrame, right: DataFrame, name: str, others: Sequence[str] = ()) -> DataFrame:
    """Inner join on an accent- and case-blind name (left spelling kept) plus exact ``others``."""
    r = right.withColumn("_name", name_key(name)).drop(name)
    return left.withColumn("_name", name_key(name)).join(r, ["_name", *others]).drop("_name")


def unpivot_months(wide: DataFrame, code: str, pattern: str, value: str) -> DataFrame:
    """Month columns (``x0_...`` to ``x11_...``) to rows; month = number in the header + 1."""
    months = [c for c in wide.columns if re.search(pattern, c)]
    long = wide.unpivot(code, months, "month", value)
    return long.withColumn("month", leading_number("month") + 1)


def unpivot_stat_dates(wide: DataFrame, ids: Sequence[str], value: str) -> DataFrame:
    """Columns such as ``mean.X2020.01.31`` to rows (ids, fun, date, value)."""
    stats = [c for c in wide.columns if c not in ids]
    long = wide.unpivot(list(ids), [f"`{c}`" for c in stats], "_label", value)
    parts = F.split("_label", r"\.X")
    day = parse_ymd(F.translate(parts[1], ".", "-"))
    return long.select(*ids, parts[0].alias("fun"), day.alias("date"), value)


def size_band(pop: Column | str, small: float = 25000, medium: float = 100000) -> Column:
    """Population band ``p``/``m``/``g``; an unknown population falls to ``g``."""
    pop = F.col(pop) if isinstance(pop, str) else pop
    return F.when(pop < small, "p").when(pop < medium, "m").otherwise("g")


def census_dimension(census: DataFrame, year: str, **bands) -> DataFrame:
    """Zone attributes of one census year with the size band."""
    return census.filter(F.col("year") == year).drop("year").withColumn("size", size_band("pop", **bands))


def capital_flag(zone: Column | str, codes: Sequence[str]) -> Column:
    """TRUE for the listed zone codes."""
    return in_set(zone, codes)


class Counter(NamedTuple):
    """Cumulative counter rows (zone, period, values, order columns) and how to step them."""

    rows: DataFrame
    values: Sequence[str]
    order: Sequence[str]
    reset_first: int | None = 1


def base_panel(
    panel: DataFrame, keys: Sequence[str], axis: Column, *, census: DataFrame, capitals: Sequence[str] = (),
    fires: DataFrame | None = None, counter: Counter | None = None, rain: DataFrame | None = None,
    cuts: DataFrame | None = None,
) -> DataFrame:
    """The panel with its features; features not given are not computed.

    ``panel`` has one row per (zone, period); the features are raw rows: ``fires`` (n_fires, fire_density) and ``rain``
    (precipitation) and ``cuts`` (area) are summed, the counter is stepped over ``axis``.  All of them and the panel are
    united, each kind with columns of its own and a flag, and grouped once, so a feature costs no shuffle of its own
    and no join.  The grid stays partitioned by zone, which windows and the census join reuse.

    A zone without fire rows keeps NULL, an observed 0 becomes 1; areas without reports become 0; a zone without counter
    rows and a period off the axis have no counter.  Feature rows without zone or period belong nowhere.
    """
    zone, period = keys
    own = [c for c in panel.columns if c not in keys]
    parts, aggs = [panel.withColumn("_panel", F.lit(True))], {c: F.max(c) for c in (*own, "_panel")}

    def take(rows: DataFrame, name: str, sums: dict[str, Column], columns: Sequence[str]) -> None:
        parts.append(rows.filter(F.col(zone).isNotNull() & F.col(period).isNotNull()).select(*keys, *columns, F.lit(True).alias(name)))
        aggs.update(sums, **{name: F.max(name)})

    for rows, name, columns in ((fires, "_fires", ["n_fires", "fire_density"]), (rain, "_rain", ["precipitation"]), (cuts, "_cuts", ["area"])):
        if rows is not None:
            take(rows, name, {c: F.sum(c) for c in columns}, columns)
    if counter is not None:
        order = {c: f"_by_{c}" for c in counter.order}
        values = {v: f"_of_{v}" for v in counter.values}
        rows = counter.rows.withColumns({new: F.col(c) for c, new in {**order, **values}.items()})
        newest = {f"{v}_total": F.max_by(values[v], F.struct(*order.values())) for v in counter.values}
        take(rows, "_counter", newest, [*order.values(), *values.values()])

    grid = aggregate_on_grid(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), [zone], period, axis, aggs)
    here = Window.partitionBy(zone)
    if counter is not None:
        grid = stepped(grid.withColumn("_counted", F.max("_counter").over(here)), zone, period, counter.values, counter.reset_first)
        on_axis = F.array_contains(axis, F.col(period)) & F.col("_counted")
        names = [f"{v}_{kind}" for v in counter.values for kind in ("total", "new")]
        grid = grid.withColumns({c: F.when(on_axis, F.col(c)) for c in names})
    if fires is not None:
        seen = F.max("_fires").over(here)
        grid = grid.withColumns({c: F.when(seen, F.coalesce(F.col(c), F.lit(0))) for c in ("n_fires", "fire_density")})
        grid = grid.withColumn("n_fires", replace_zero("n_fires", 1))
    if cuts is not None:
        grid = fill_null(grid, {"area": 0})
    kept = grid.filter("_panel").drop("_panel", "_fires", "_rain", "_cuts", "_counter", "_counted")
    return kept.join(census, zone, "left").withColumn("capital", capital_flag(zone, capitals))

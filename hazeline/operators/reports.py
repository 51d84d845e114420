"""Questions asked of the base panel.

``effects`` maps a response name to its coefficient per day above the threshold, as a Column: a literal, or
:func:`hazeline.functions.effects.coefficient` on a fitted table.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeline.functions.effects import extra_share, half_up_mean, percent_text, rate_ratio
from hazeline.functions.nulls import na_mean, na_sum
from hazeline.operators.features import size_band

Effects = dict[str, Column]


def season_filter(panel: DataFrame, period: str, first: int, last: int) -> DataFrame:
    """Rows of the periods ``first`` .. ``last``, both included."""
    return panel.filter(F.col(period).between(first, last))


def with_effects(report: DataFrame, effects: Effects, days: str, *, text: bool = True) -> DataFrame:
    """``pct_<response>``: extra share at ``days`` as text for screens, or the raw ratio for downloads."""
    show = percent_text if text else (lambda share: share)
    return report.withColumns({f"pct_{r}": show(extra_share(b, days)) for r, b in effects.items()})


def _chosen(panel: DataFrame, period: str, periods: Iterable, states: Iterable | None = None) -> DataFrame:
    out = panel.filter(F.col(period).isin(list(periods)))
    return out if states is None else out.filter(F.col("state").isin(list(states)))


def report_overall(panel, effects, *, period, periods, states, text=True) -> DataFrame:
    """One row: mean days above and the extra share it stands for.  The share uses the rounded mean."""
    mean = _chosen(panel, period, periods, states).agg(half_up_mean("days_above").alias("mean_days"))
    return with_effects(mean, effects, "mean_days", text=text)


def report_states(panel, effects, *, period, periods, text=True) -> DataFrame:
    """Per state, all states, most days first."""
    mean = _chosen(panel, period, periods).groupBy("state").agg(half_up_mean("days_above").alias("mean_days"))
    return with_effects(mean, effects, "mean_days", text=text).orderBy(F.desc_nulls_last("mean_days"))


def _by_zone(rows: DataFrame, names: DataFrame, zone: str, effects: Effects, text: bool) -> DataFrame:
    mean = rows.groupBy(zone).agg(half_up_mean("days_above").alias("days_above"))
    named = mean.join(names.select(zone, "name", "state"), zone)
    return with_effects(named, effects, "days_above", text=text).orderBy(F.desc_nulls_last("days_above"))


def only_zones(panel: DataFrame, flagged: DataFrame, zone: str) -> DataFrame:
    """Panel rows of the flagged zones; the flag list stays a table."""
    return panel.join(flagged.select(zone), zone, "left_semi")


def report_vulnerable(panel, flagged, names, effects, *, zone, period, periods, text=True) -> DataFrame:
    """Per flagged zone, all states."""
    return _by_zone(_chosen(only_zones(panel, flagged, zone), period, periods), names, zone, effects, text)


def report_zones(panel, names, effects, *, zone, period, periods, states, text=True) -> DataFrame:
    """Per zone of the chosen states."""
    return _by_zone(_chosen(panel, period, periods, states), names, zone, effects, text)


def report_totals(
    rows: DataFrame, effects: Effects, keys: Sequence[str], *,
    measures: Sequence[str] = ("admissions", "confirmed", "days_above"), measures_in_key: bool = False,
) -> DataFrame:
    """Totals, means and raw extra share (from the unrounded mean) per ``keys``.

    ``measures_in_key`` also groups by the measures of ``effects``, which collapses equal rows of a zone.
    """
    keys = [*keys, *effects] if measures_in_key else list(keys)
    aggs = [f(m).alias(f"{p}_{m}") for m in measures for p, f in (("total", na_sum), ("mean", na_mean))]
    return with_effects(rows.groupBy(*keys).agg(*aggs), effects, "mean_days_above", text=False)


def report_single_state_period(panel, effects, keys, *, period, value, state) -> DataFrame:
    """One state in one period, fire counts included."""
    rows = panel.filter((F.col("state") == state) & (F.col(period) == value))
    return report_totals(rows, effects, keys, measures=("admissions", "confirmed", "days_above", "n_fires"))


def counterfactual(panel: DataFrame, effects: Effects, *, compat: bool = False) -> DataFrame:
    """Expected counts had there been no day above the threshold: observed / rate ratio.

    ``compat`` divides every response by the first response's ratio, as the published export did.
    """
    ratios = {f"ratio_{r}": rate_ratio(b, "days_above") for r, b in effects.items()}
    first = next(iter(effects))
    expected = {f"{r}_without": F.col(r) / F.col(f"ratio_{first if compat else r}") for r in effects}
    return panel.withColumns(ratios).withColumns(expected).withColumn("size", size_band("pop"))


def source_reconciliation(panel: DataFrame, period: str, columns: Sequence[str]) -> DataFrame:
    """State x period sums of two sources side by side."""
    return panel.groupBy("state", period).agg(*[na_sum(c).alias(c) for c in columns])


def log_histogram(df: DataFrame, value: str, bins_per_decade: int = 5) -> DataFrame:
    """Counts on a log10 axis; values of 0 or below have no bin."""
    bin_no = F.floor(F.log10(value) * bins_per_decade)
    counted = df.filter(F.col(value) > 0).groupBy(bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("lower", F.pow(F.lit(10.0), F.col("bin") / F.lit(float(bins_per_decade))))


def zone_profile(panel: DataFrame, zone: str, measures: dict[str, str], *, required: str) -> DataFrame:
    """Unweighted propagating means per zone; rows without ``required`` are left out first."""
    rows = panel.filter(F.col(required).isNotNull())
    return rows.groupBy(zone).agg(*[na_mean(c).alias(out) for c, out in measures.items()])

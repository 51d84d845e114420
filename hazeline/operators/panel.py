"""Line list to daily and monthly zone panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeline.functions.dates import lagged, parse_dmy
from hazeline.functions.nulls import as_count, coded_yes, exceeds, in_set, is_reading, na_mean, na_sum, skip_mean
from hazeline.operators.grid_fill import aggregate_on_grid

# Coded columns of the admissions line list.
SYMPTOMS = ("tosse", "garganta", "desc_resp", "saturacao", "perd_olft", "perd_pala")
FLAGS = ("confirmed", "undetermined", "symptomatic", "died", "died_confirmed")
COUNTS = ("admissions", "confirmed", "undetermined", "symptomatic", "deaths", "deaths_confirmed")
_COUNT_OF = dict(zip(COUNTS[1:], FLAGS))


def in_zones(df: DataFrame, zone: str, zones: DataFrame, zones_key: str | None = None) -> DataFrame:
    """Rows whose zone is listed in the ``zones`` table (a semi join, nothing collected)."""
    wanted = zones.select(F.col(zones_key or zone).alias(zone))
    return df.join(wanted, zone, "left_semi")


def clean_readings(df: DataFrame, value: str, out: str = "reading") -> DataFrame:
    """Readings as doubles, without NULL, NaN or the text ``NaN``."""
    return df.withColumn(out, F.col(value).try_cast("double")).filter(is_reading(out))


def classify_cases(line_list: DataFrame, *, first: str, last: str, lag_days: int = 7) -> DataFrame:
    """Coded line list to typed flags, kept where the exposure date is in [first, last].

    Every class outside 1..3 is ``undetermined``, NULL and 5 (= confirmed) included.  All flags are non-NULL.
    """
    flagged = line_list.withColumns({
        "admitted": parse_dmy("dt_interna"),
        "outcome_date": parse_dmy("dt_evoluca"),
        "undetermined": ~in_set("classi_fin", (1, 2, 3)),
        "confirmed": coded_yes("classi_fin", 5),
        "fever": coded_yes("febre"),
        "died": coded_yes("evolucao", 2),
        "n_symptoms": sum((coded_yes(s).cast("int") for s in SYMPTOMS), F.lit(0)),
    })
    suspected = F.col("confirmed") | (F.col("undetermined") & F.col("fever") & (F.col("n_symptoms") > 0))
    not_ruled_out = F.coalesce(F.col("pos_pcrout") != 2, F.lit(True))
    flagged = flagged.withColumns({
        "exposed": lagged("admitted", lag_days),
        "symptomatic": suspected & not_ruled_out,
        "died_confirmed": F.col("died") & F.col("confirmed"),
    })
    return flagged.filter(F.col("exposed").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def _count_aggs() -> dict[str, Column]:
    return {"admissions": F.count(F.lit(1))} | {n: F.sum(as_count(f)) for n, f in _COUNT_OF.items()}


def daily_counts(cases: DataFrame, zone: str, date: str, axis: Column) -> DataFrame:
    """Admissions and the five flag counts per zone and ``date``, zero-filled over ``axis``.

    Dates off the axis and the NULL date keep their own rows (outcome dates are often missing).
    """
    return aggregate_on_grid(cases, [zone], date, axis, _count_aggs(), dict.fromkeys(COUNTS, 0))


def daily_panel(
    cases: DataFrame, readings: DataFrame, zone: str, date: str, axis: Column, *,
    reading: str = "reading", threshold: float = 25.0,
) -> DataFrame:
    """Zero-filled daily counts, full outer joined to the zone's daily mean reading, with an exceedance flag.

    Both inputs are stacked and grouped once by (zone, date): the same rows as a full outer join of the two
    aggregates, with one exchange in place of four.  Only zones with cases are completed, counts are
    zero-filled, readings are not.
    """
    case_rows = cases.select(zone, date, *FLAGS, F.lit(1).alias("_case"), F.lit(None).cast("double").alias(reading))
    reading_rows = readings.select(zone, date, F.col(reading).cast("double"))
    stacked = case_rows.unionByName(reading_rows, allowMissingColumns=True)
    aggs = _count_aggs() | {"admissions": F.count("_case"), reading: F.avg(reading)}
    panel = aggregate_on_grid(
        stacked, [zone], date, axis, aggs, dict.fromkeys(COUNTS, 0), only_if=F.max("admissions") > 0
    )
    return panel.withColumn("above", exceeds(reading, threshold))


def roll_up(
    daily: DataFrame, keys: Sequence[str], *, reading: str = "reading", skip_missing: bool = False
) -> DataFrame:
    """Daily panel to one row per ``keys`` (zone plus period columns).

    A missing day makes the mean reading missing, or is skipped with ``skip_missing``.  Days above the
    threshold always propagate.
    """
    mean = skip_mean if skip_missing else na_mean
    return daily.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in COUNTS],
        mean(reading).alias(reading),
        na_sum(as_count("above")).alias("days_above"),
    )


def monthly_panel(daily: DataFrame, zone: str, date: str, *, pool_years: bool = False, **kw) -> DataFrame:
    """:func:`roll_up` by calendar month; ``pool_years`` drops the year from the key."""
    dated = daily.withColumns({"year": F.year(date), "month": F.month(date)})
    return roll_up(dated, [zone, "month"] if pool_years else [zone, "year", "month"], **kw)


def monthly_mean(readings: DataFrame, zone: str, date: str, reading: str, *, pool_years: bool = False) -> DataFrame:
    """Propagating mean reading per zone and month."""
    keys = [F.col(zone), F.month(date).alias("month")] + ([] if pool_years else [F.year(date).alias("year")])
    return readings.groupBy(*keys).agg(na_mean(reading).alias(f"{reading}_mean"))

"""Gridded readings as a long table: (run_ts, band_ts, cell_x, cell_y, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.functions.dates import clock, shift_hours

CELL = ("cell_x", "cell_y")


def consolidate(bands: DataFrame, *, hours: int = -5, factor: float = 1e9) -> DataFrame:
    """Local clock, both dates, band label and converted unit (kg to ug by default)."""
    out = bands.withColumn("local_ts", shift_hours("band_ts", hours)).withColumns({
        "date_utc": F.to_date("band_ts"),
        "date_local": F.to_date("local_ts"),
        "value": F.col("value") * F.lit(factor),
    })
    # The label pairs the UTC day with the local clock, as the published band names do.
    label = F.concat_ws("_", F.lit("ymd"), F.date_format("date_utc", "yyyy-MM-dd"), clock("local_ts"))
    return out.withColumn("band", label)


def daily_mean(grid: DataFrame, *, day_basis: str = "utc", dedupe: str = "none") -> DataFrame:
    """Mean of a day's bands per cell.

    ``dedupe='latest_run'`` keeps only the newest forecast run where two runs cover one instant.
    """
    date = {"utc": "date_utc", "local": "date_local"}[day_basis]
    if dedupe == "latest_run":
        value = F.max_by("value", "run_ts").alias("value")
        grid = grid.groupBy(*CELL, date, "band_ts").agg(value)
    elif dedupe != "none":
        raise ValueError(f"dedupe must be 'none' or 'latest_run', not {dedupe!r}")
    return grid.groupBy(*CELL, F.col(date).alias("date")).agg(F.avg("value").alias("value"))

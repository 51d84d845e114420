"""Resumable batches: only what has no output yet is processed."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from hazeline.sources.tables import write_grid_days


def pending(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct ``keys`` of ``work`` without an entry in ``done``."""
    return work.select(*keys).distinct().join(done.select(*keys).distinct(), list(keys), "left_anti")


def add_missing_days(
    spark: SparkSession, grid: DataFrame, path: str, to_days: Callable[[DataFrame], DataFrame], day: str
) -> None:
    """Run ``to_days`` over the days of ``grid`` that ``path`` does not hold and add them there.

    Both day lists are as long as the calendar.  The days done come from partition values (no column is read), and the
    filter on ``grid`` is a semi join, broadcast by Spark at that size.
    """
    try:
        done = spark.read.parquet(path).select("date").distinct().withColumnRenamed("date", day)
    except AnalysisException as error:  # no output yet
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        done = grid.select(day).limit(0)
    todo = pending(grid, done, [day])
    write_grid_days(to_days(grid.join(todo, day, "left_semi")), path)

"""Date parsing and calendar axes.  Bad dates become NULL (plain ``to_date`` raises under ANSI)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_dmy(c: Column | str) -> Column:
    """``31/12/2020`` to DATE."""
    return F.try_to_date(_col(c), "d/M/yyyy")


def parse_mdy(c: Column | str) -> Column:
    """``12/31/2020`` to DATE."""
    return F.try_to_date(_col(c), "M/d/yyyy")


def parse_ymd(c: Column | str) -> Column:
    """``2020-12-31`` to DATE."""
    return F.try_to_date(_col(c), "yyyy-M-d")


def lagged(c: Column | str, days: int) -> Column:
    """Date moved ``days`` back: exposure lag before an admission, reporting lag of a counter."""
    return F.date_sub(_col(c), days)


def shift_hours(ts: Column | str, hours: int) -> Column:
    """Timestamp on a fixed-offset local clock."""
    return _col(ts) + F.make_dt_interval(F.lit(0), F.lit(hours))


def clock(ts: Column | str) -> Column:
    """Clock time as ``HH:mm:ss`` text."""
    return F.date_format(_col(ts), "HH:mm:ss")


def day_axis(first: Column | str, last: Column | str) -> Column:
    """Every day from ``first`` to ``last``; strings are ISO dates."""
    lo, hi = (F.lit(d).cast("date") if isinstance(d, str) else d for d in (first, last))
    return F.sequence(lo, hi)


def number_axis(first: int, last: int) -> Column:
    """Whole numbers ``first`` .. ``last`` (month or week numbers)."""
    return F.sequence(F.lit(first), F.lit(last))

"""Missing-value rules as Column functions.

Two algebras live side by side: *propagating* aggregates (one missing input makes the result missing)
and Spark's own *skipping* ones.  Panels choose per measure, so both are spelled out here.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _complete(x: Column) -> Column:
    return F.count(F.lit(1)) == F.count(x)


def na_mean(x: Column | str) -> Column:
    """Mean that is NULL as soon as one input is NULL."""
    return F.when(_complete(_col(x)), F.avg(_col(x)))


def na_sum(x: Column | str) -> Column:
    """Sum that is NULL as soon as one input is NULL."""
    return F.when(_complete(_col(x)), F.sum(_col(x)))


def skip_mean(x: Column | str) -> Column:
    """Mean over the non-NULL inputs; a group without any gives NULL (never NaN)."""
    return F.avg(_col(x))


def as_count(flag: Column | str) -> Column:
    """Boolean as 0/1 bigint, NULL kept, ready for ``sum``."""
    return _col(flag).cast("bigint")


def in_set(x: Column | str, values: Iterable) -> Column:
    """Set membership that is FALSE, never NULL, for a NULL input."""
    return F.coalesce(_col(x).isin(list(values)), F.lit(False))


def coded_yes(x: Column | str, code: int = 1) -> Column:
    """TRUE where a coded answer equals ``code``; NULL counts as no."""
    return F.coalesce(_col(x) == F.lit(code), F.lit(False))


def is_reading(x: Column | str) -> Column:
    """TRUE for a usable number: neither NULL nor NaN."""
    return _col(x).isNotNull() & ~F.isnan(_col(x))


def exceeds(x: Column | str, threshold: float) -> Column:
    """Threshold flag, strict; NULL in gives NULL out."""
    return _col(x) > F.lit(threshold)


def clamp_negative(x: Column | str) -> Column:
    """Negatives become 0, NULL stays NULL (``greatest`` would turn it into 0)."""
    return F.when(_col(x) < 0, F.lit(0)).otherwise(_col(x))


def replace_zero(x: Column | str, value: float) -> Column:
    """Exact zeros become ``value``; everything else, NULL included, is kept."""
    return F.when(_col(x) == 0, F.lit(value)).otherwise(_col(x))


def fill_null(df: DataFrame, fill: dict[str, object]) -> DataFrame:
    """NULL in the named columns becomes the given value, column types kept."""
    kind = {f.name: f.dataType for f in df.schema}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(kind[c])) for c, v in fill.items()})

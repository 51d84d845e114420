"""Effect sizes of log-link coefficients, and the rounding rules of the reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rate_ratio(coef: Column, dose: Column | str) -> Column:
    """Expected-count ratio of ``dose`` units against none."""
    return F.exp(coef * (F.col(dose) if isinstance(dose, str) else dose))


def extra_share(coef: Column, dose: Column | str) -> Column:
    """Share of extra events against a dose of 0 (0.05 = 5 % more)."""
    return rate_ratio(coef, dose) - F.lit(1.0)


def percent_text(share: Column | str) -> Column:
    """``0.0512`` to ``5.1%``; NULL stays NULL."""
    share = F.col(share) if isinstance(share, str) else share
    return F.when(share.isNotNull(), F.concat(F.format_string("%.1f", share * 100), F.lit("%")))


def half_up_mean(x: Column | str, digits: int = 2) -> Column:
    """Mean of non-negative whole numbers, half-up on the exact fraction; NULL if any input is NULL.

    Rounding a double mean depends on how a tie such as 23/40 happens to be stored.  Integer arithmetic does not.
    """
    x = F.col(x) if isinstance(x, str) else x
    n = F.count(F.lit(1))
    scale = 10**digits
    exact = F.call_function("div", F.lit(2 * scale) * F.sum(x.cast("bigint")) + n, F.lit(2) * n)
    return F.when(n == F.count(x), exact.cast("double") / F.lit(float(scale)))


def coefficient(effects: DataFrame, model: str, term: str) -> Column:
    """One estimate out of a coefficient table, as a lazy scalar."""
    hit = effects.filter((F.col("model") == model) & (F.col("term") == term))
    return hit.agg(F.first("estimate").alias("estimate")).scalar()


def effect_sizes(effects: DataFrame) -> DataFrame:
    """Coefficient table plus ``decrease`` = 1 - exp(b) and ``increase`` = exp(b) - 1."""
    return effects.withColumns({
        "decrease": F.lit(1.0) - F.exp("estimate"),
        "increase": F.exp("estimate") - F.lit(1.0),
    })


def coefficients_wide(effects: DataFrame, terms: list[str]) -> DataFrame:
    """One row per model, one column per term."""
    return effects.groupBy("model").pivot("term", terms).agg(F.first("estimate"))

"""Length of stay with the exposure and case counts at the time of infection."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.functions.dates import parse_dmy
from hazeline.functions.nulls import exceeds, in_set, replace_zero

HEAVY_ROWS, SALTS = 1_000_000, 64


def with_lookup(facts: DataFrame, lookup: DataFrame, keys: Sequence[str], *, counted: DataFrame | None = None, heavy: int = HEAVY_ROWS, salts: int = SALTS) -> DataFrame:
    """Left join of facts to a table unique per ``keys`` that no key can hold up.

    Keys with more than ``heavy`` facts are counted first, as part of the query.  Their facts are dealt over ``salts``
    parts by a hash of the row, and their one lookup row is repeated for each part; all other keys join as
    they are.  There are at most rows / ``heavy`` such keys, so their list is broadcast.  ``counted`` is a cheaper table
    with the facts' keys.
    """
    keys = list(keys)
    crowded = (facts if counted is None else counted).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > heavy).select(*keys, F.lit(True).alias("_heavy"))
    crowded = F.broadcast(crowded)
    spot = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in facts.columns]), F.lit(salts)).cast("int")
    lost = reduce(or_, [F.col(k).isNull() for k in keys])  # meets nothing, and is dealt out likewise
    dealt = facts.join(crowded, keys, "left").withColumn("_salt", F.when(F.col("_heavy") | lost, spot).otherwise(0)).drop("_heavy")
    last = F.when(F.col("_heavy"), salts - 1).otherwise(0)
    copied = lookup.join(crowded, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), last))).drop("_heavy")
    return dealt.join(copied, [*keys, "_salt"], "left").drop("_salt")


def length_of_stay(
    cases: DataFrame, readings: DataFrame, counter: DataFrame, zone: str, *, died: bool | None = None,
    season: tuple[int, ...] = (7, 8, 9, 10), longest: int = 100, threshold: float = 25.0, heavy: int = HEAVY_ROWS, salts: int = SALTS,
) -> DataFrame:
    """One row per classified case with a known stay of 0..``longest`` days: of survivors, of deaths (``died``), or, with
    ``died`` left open, of both in one pass, told apart by their column ``died``.

    The end is the outcome date, else the closing date; a stay of 0 days counts as 0.01.  ``readings`` is
    unique per (zone, exposed) and ``counter`` per (zone, month): both are left joined, so rows never multiply.  Calling it
    runs nothing.
    """
    kept = cases if died is None else cases.filter(F.col("died") if died else ~F.col("died"))
    closed = kept.withColumn("ended", F.coalesce(parse_dmy("dt_evoluca"), parse_dmy("dt_encerra")))
    days = F.datediff("ended", "admitted").cast("double")
    stays = closed.withColumns({"month": F.month("exposed"), "stay": replace_zero(days, 0.01)})
    stays = stays.withColumn("in_season", in_set("month", season)).filter(F.col("stay").between(0, longest))
    exposed = with_lookup(stays, readings.select(zone, "exposed", "reading"), [zone, "exposed"], heavy=heavy, salts=salts)
    return with_lookup(exposed.withColumn("above", exceeds("reading", threshold)), counter, [zone, "month"], counted=stays, heavy=heavy, salts=salts)

"""Document fingerprints as bottom-k sketches, in DataFrame functions only.

A sketch is the sorted array of the ``k`` smallest distinct hashes of a text's word shingles.  Words are runs without
white space.  With fewer words than a shingle takes, the whole sequence is the one shingle; without words the sketch
is empty.  Null texts count as empty.  Sketches of parts merge into the sketch of the whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLANK = "[\\x20\\x09-\\x0D]+"
SPREAD = float(2**64)


def shingle_hashes(text: Column, width: int = 5) -> Column:
    """Hashes of all shingles, repeats included."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), BLANK), lambda w: w != "")
    whole = F.when(F.size(words) > 0, F.array(F.xxhash64(F.concat_ws(" ", words)))).otherwise(F.array().cast("array<bigint>"))

    def runs(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(width)]))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) >= width, F.element_at(F.transform(F.array(hashed), runs), 1)).otherwise(whole)


def sketch(text: Column, k: int = 128, width: int = 5) -> Column:
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text, width))), 1, k)


def merge(a: Column, b: Column, k: int = 128) -> Column:
    """Sketch of the union of two parts' shingles."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = 128) -> Column:
    """Estimated Jaccard: the share of the union's ``k`` smallest hashes that both hold.  Two empty sketches: 1."""
    union = merge(a, b, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, 1.0).otherwise(both / F.greatest(F.size(union), F.lit(1)))


def distinct_count(s: Column, k: int = 128) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    reach = (F.element_at(s, -1).cast("double") + SPREAD / 2) / SPREAD
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / reach)


def containment(a: Column, b: Column, k: int = 128) -> Column:
    """Estimated share of the first one's shingles that the second holds; 1 for an empty first sketch."""
    j = resemblance(a, b, k)
    both = j * distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), both / F.greatest(distinct_count(a, k), F.lit(1.0))))


def merge_groups(df: DataFrame, by: list[str], s: str = "sketch", k: int = 128) -> DataFrame:
    """One sketch per group: every task first keeps its own ``k`` smallest hashes of a group, so a hot group sends
    little.  A group whose sketches are all empty or null gets an empty one."""
    rows = df.select(*by, F.explode_outer(s).alias("_h")).distinct()
    # the rank is limited within each task before its exchange
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("_h").asc_nulls_last()))
    kept = rows.withColumn("_r", rank).filter(F.col("_r") <= k)
    return kept.groupBy(*by).agg(F.sort_array(F.collect_set("_h")).alias(s))


RANGE_BYTES, TASK_RANGES = 8 << 20, 4


def with_next(df: DataFrame, key: str, columns: list[str], parts: int | None = None) -> DataFrame:
    """Adds ``next_<column>`` from the row with the next larger ``key``; the last row takes those of the first.

    Rows are cut into ranges of the key at approximate quantiles (all the driver ever holds): as many as the first carried
    column's bytes ask for, some ``RANGE_BYTES`` each, unless ``parts`` is given.  Ranges are dealt over tasks that hold
    some ``TASK_RANGES`` of them.  The first row of a range is copied into the range before, so that no window spans
    ranges.  Rows with a null key come first; equal keys are ordered by the carried columns, and share a range.  The
    names ``_part``, ``_home`` and ``_next`` are taken.
    """
    if parts is None:
        weight = df.agg(F.coalesce(F.sum(F.octet_length(columns[0])), F.lit(0))).first()[0]
        parts = max(256, -(-weight // RANGE_BYTES))
    share = [i / parts for i in range(1, parts)]
    found = df.agg(
        F.percentile_approx(key, F.lit(share), F.lit(20 * parts)).alias("cuts"), F.min(key).alias("least"),
        F.max(F.col(key).isNull()).alias("holes"),
    ).first()
    cuts = sorted(set(found.cuts or []))
    bounds = F.lit(cuts).cast("array<bigint>") if cuts else F.array().cast("array<bigint>")
    part = F.when(F.col(key).isNull(), 0).otherwise(F.size(F.filter(bounds, lambda c: c <= F.col(key))))
    opens = F.coalesce(F.array_contains(bounds, F.col(key)), F.lit(False))
    first = F.col(key).isNull() if found.holes else F.col(key) == F.lit(found.least)

    def home(at: Column, late: int) -> Column:
        return F.struct(at.cast("int").alias("part"), F.lit(late).alias("late"))

    none = F.array().cast("array<struct<part:int,late:int>>")
    homes = F.concat(
        F.array(home(F.col("_part"), 0)), F.when(opens, F.array(home(F.col("_part") - 1, 1))).otherwise(none),
        F.when(first, F.array(home(F.lit(len(cuts)), 2))).otherwise(none),
    )
    rows = df.withColumn("_part", part).withColumn("_home", F.explode(homes))
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, parts // TASK_RANGES)
    rows = rows.repartition(tasks, F.col("_home.part"))
    w = Window.partitionBy("_home.part").orderBy("_home.late", F.col(key).asc_nulls_first(), *columns)
    out = rows.withColumn("_next", F.lead(F.struct(*columns)).over(w)).filter(F.col("_home.late") == 0)
    return out.select(*df.columns, *[F.col(f"_next.{c}").alias(f"next_{c}") for c in columns])

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hazeline.functions.dates import day_axis, number_axis
from hazeline.operators import grid_fill as g

D = [dt.date(2020, 1, i) for i in range(1, 10)]


def cells(spark):
    rows = [("a", D[1], 2), ("a", None, 5), ("a", D[8], 7), ("b", D[2], None), ("a", D[1], 3)]
    return spark.createDataFrame(rows, "zone string, date date, n bigint")


def test_complete_keeps_off_axis_null_and_repeated_rows(spark):
    out = g.complete(cells(spark), ["zone"], "date", day_axis("2020-01-01", "2020-01-03"), {"n": 0})
    got = sorted(((r["zone"], r["date"], r["n"]) for r in out.collect()), key=str)
    want = [("a", D[0], 0), ("a", D[1], 2), ("a", D[1], 3), ("a", D[2], 0), ("a", D[8], 7), ("a", None, 5),
            ("b", D[0], 0), ("b", D[1], 0), ("b", D[2], 0)]
    assert got == sorted(want, key=str)


def test_complete_twice_changes_nothing(spark):
    axis = day_axis("2020-01-01", "2020-01-03")
    once = g.complete(cells(spark), ["zone"], "date", axis, {"n": 0})
    twice = g.complete(once, ["zone"], "date", axis, {"n": 0})
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))


def test_complete_with_null_key_and_two_keys(spark):
    df = spark.createDataFrame([(None, "x", 1, 1), ("a", "y", 2, 1)], "k string, l string, month int, n int")
    out = g.complete(df, ["k", "l"], "month", number_axis(1, 3), {"n": 0})
    assert out.count() == 6 and out.agg(F.sum("n")).first()[0] == 2


def test_aggregate_on_grid(spark):
    out = g.aggregate_on_grid(cells(spark), ["zone"], "date", day_axis("2020-01-01", "2020-01-03"),
                              {"rows": F.count(F.lit(1)), "n": F.sum("n")}, {"rows": 0})
    got = {(r["zone"], r["date"]): (r["rows"], r["n"]) for r in out.collect()}
    assert got == {
        ("a", D[0]): (0, None), ("a", D[1]): (2, 5), ("a", D[2]): (0, None), ("a", D[8]): (1, 7), ("a", None): (1, 5),
        ("b", D[0]): (0, None), ("b", D[1]): (0, None), ("b", D[2]): (1, None),
    }


def test_aggregate_on_grid_only_completes_wanted_keys(spark):
    out = g.aggregate_on_grid(cells(spark), ["zone"], "date", day_axis("2020-01-01", "2020-01-03"),
                              {"n": F.sum("n")}, only_if=F.max("n") > 0)
    assert {r["zone"]: r["c"] for r in out.groupBy("zone").agg(F.count(F.lit(1)).alias("c")).collect()} == {"a": 5, "b": 1}


def test_rollup_after_grid_needs_no_further_exchange(spark):
    out = g.aggregate_on_grid(cells(spark), ["zone"], "date", day_axis("2020-01-01", "2020-01-03"), {"n": F.sum("n")})
    plan = out.groupBy("zone", F.month("date")).agg(F.sum("n"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_observed_range(spark):
    df = cells(spark)
    axis = spark.range(1).select(g.observed_range(df, "date").alias("a")).first()["a"]
    assert axis == D[1:9]


def test_fill_down_and_increments_stay_inside_the_zone(spark):
    df = spark.createDataFrame([("a", 1, 3), ("a", 2, None), ("a", 3, 8), ("b", 1, None), ("b", 2, 4)], "zone string, m int, x int")
    filled = g.fill_down(df, "zone", "m", ["x"])
    got = [tuple(r) for r in g.increments(filled, "zone", "m", {"x": "dx"}).orderBy("zone", "m").collect()]
    assert got == [("a", 1, 3, None), ("a", 2, 3, 0), ("a", 3, 8, 5), ("b", 1, None, None), ("b", 2, 4, None)]


@pytest.mark.parametrize("parts", [1, 7])
def test_surrogate_id_is_the_rank(spark, parts):
    zones = spark.createDataFrame([(i * 3 % 101, "x") for i in range(101)], "code int, other string").repartition(parts)
    out = g.surrogate_id(zones, "code")
    assert out.columns == ["code", "other", "zone_id"]
    assert sorted((r["code"], r["zone_id"]) for r in out.collect()) == [(i, i + 1) for i in range(101)]
    assert g.surrogate_id(zones.limit(0), "code").count() == 0


def test_surrogate_id_over_many_ranges_needs_no_window(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = g.surrogate_id(spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("code")), "code")
        assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
        rows = sorted((r["code"], r["zone_id"]) for r in out.collect())
        assert [i for _, i in rows] == list(range(1, 20_001)) and out.rdd.getNumPartitions() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_wild_date_is_refused(spark):
    df = spark.sql("select 'a' zone, date'2020-01-01' date union all select 'b', date'9999-01-01'")
    axis = g.observed_range(df, "date")
    with pytest.raises(Exception, match="spans more than"):
        spark.range(1).select(F.size(axis)).collect()
    assert spark.range(1).select(F.size(g.observed_range(df.filter("zone = 'a'"), "date")).alias("n")).first()["n"] == 1

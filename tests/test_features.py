from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hazeline.functions.dates import day_axis, number_axis
from hazeline.operators import features, stay
from hazeline.operators import panel as panel_

D = dt.date


def increments(spark, rows, **kw):
    df = spark.createDataFrame(rows, "zone string, date date, cases bigint")
    args = dict(first="2020-01-01", last="2020-12-31", period=F.month("date"), axis=number_axis(1, 4), lag_days=14) | kw
    out = features.counter_increments(df, "zone", "date", ["cases"], **args)
    return [(r["period"], r["cases_total"], r["cases_new"]) for r in out.orderBy("zone", "period").collect()]


ROWS = [
    ("a", D(2020, 1, 10), 99),  # lagged into the year before: out
    ("a", D(2020, 1, 20), 5), ("a", D(2020, 2, 20), 7), ("a", D(2020, 2, 25), 9), ("a", D(2020, 5, 1), 6),
]


def test_counter_increments_reset_carry_and_clamp(spark):
    assert increments(spark, ROWS) == [(1, 0, 0), (2, 9, 9), (3, 9, 0), (4, 6, 0)]


def test_counter_increments_without_reset(spark):
    assert increments(spark, ROWS, reset_first=None) == [(1, 5, 0), (2, 9, 4), (3, 9, 0), (4, 6, 0)]


def test_increments_add_up_when_nothing_falls(spark):
    rows = [("a", D(2020, m, 20), 10 * m * m) for m in range(2, 6)]
    got = increments(spark, rows, lag_days=0, axis=number_axis(1, 6))
    assert sum(n for _, _, n in got) == got[-1][1] - got[0][1]


def test_last_in_period_is_null_when_the_newest_value_is(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, None), ("b", 1, 3)], "z string, t int, x int")
    got = {r["z"]: r["x"] for r in features.last_in_period(df, ["z"], ["t"], ["x"]).collect()}
    assert got == {"a": None, "b": 3}


def test_complete_months_drops_unknown_zones(spark):
    df = spark.createDataFrame([("a", 2, 5), ("a", 2, 1), (None, 1, 7)], "z string, m int, n bigint")
    got = [tuple(r) for r in features.complete_months(df, "z", "m", number_axis(1, 3), ["n"]).orderBy("m").collect()]
    assert got == [("a", 1, 0), ("a", 2, 6), ("a", 3, 0)]


def test_area_by_name_merges_spellings_and_keeps_states_apart(spark):
    cuts = spark.createDataFrame(
        [("São Félix", "PA", 1, 2.0), ("SAO FELIX", "PA", 1, 3.0), ("sao felix", "MT", 2, 7.0), ("Nowhere", "PA", 1, 1.0)],
        "name string, state string, month int, area double")
    names = spark.createDataFrame([("11", "São Félix", "PA"), ("22", "Sao Felix", "MT")], "zone string, name string, state string")
    out = features.area_by_name(cuts, names, name="name", state="state", month="month", axis=number_axis(1, 2), area="area", zone="zone")
    assert sorted(map(tuple, out.collect())) == [("11", 1, 5.0), ("11", 2, 0.0), ("22", 1, 0.0), ("22", 2, 7.0)]


def test_unpivot_months_in_file_order(spark):
    cols = [f"x{i}_precipitation" for i in (0, 1, 10, 11, 2)]
    wide = spark.createDataFrame([("z", 0.0, 1.0, 10.0, None, 2.0)], "code string, " + ", ".join(f"{c} double" for c in cols))
    got = [tuple(r) for r in features.unpivot_months(wide, "code", r"^x\d+_precipitation$", "p").orderBy("month").collect()]
    assert got == [("z", 1, 0.0), ("z", 2, 1.0), ("z", 3, 2.0), ("z", 11, 10.0), ("z", 12, None)]


def test_unpivot_stat_dates(spark):
    wide = spark.createDataFrame([("z", 1.0, 2.0)], "zone string, `mean.X2020.01.31` double, `max.X2020.01.31` double")
    got = sorted(map(tuple, features.unpivot_stat_dates(wide, ["zone"], "v").collect()))
    assert got == [("z", "max", D(2020, 1, 31), 2.0), ("z", "mean", D(2020, 1, 31), 1.0)]


@pytest.mark.parametrize("pop, band", [(24999, "p"), (25000, "m"), (99999, "m"), (100000, "g"), (None, "g")])
def test_size_band(spark, pop, band):
    df = spark.createDataFrame([(pop,)], "pop bigint")
    assert df.select(features.size_band("pop")).first()[0] == band


def test_census_keeps_one_year(spark):
    df = spark.createDataFrame([("a", "2000", 1), ("a", "2010", 30000)], "zone string, year string, pop bigint")
    assert [tuple(r) for r in features.census_dimension(df, "2010").collect()] == [("a", 30000, "m")]


def base_inputs(spark):
    panel = spark.createDataFrame([("a", 1, 5, 0.5), ("a", 2, None, None), ("b", 1, 7, 1.5), (None, 1, 9, 2.5), ("c", 9, 1, 0.0), ("c", 2, 1, 0.0)],
                                  "zone string, month int, admissions bigint, reading double")
    census = spark.createDataFrame([("a", 10)], "zone string, pop bigint")
    fires = spark.createDataFrame([("a", 1, 0, 0.0), ("a", 2, 1, 2.0), ("a", 2, 3, 1.0), ("c", 1, 1, 1.0), (None, 1, 8, 8.0)],
                                  "zone string, month int, n_fires bigint, fire_density double")
    rain = spark.createDataFrame([("a", 1, 4.0), ("a", 1, 1.0), ("z", 1, 1.0)], "zone string, month int, precipitation double")
    cuts = spark.createDataFrame([("a", 2, 1.5)], "zone string, month int, area double")
    counted = spark.createDataFrame([("a", 1, 1, 7), ("a", 3, 1, 20), ("a", 3, 2, 30), ("c", 1, 1, 4), ("c", 2, 1, 3)], "zone string, month int, at int, cases bigint")
    return panel, census, fires, rain, cuts, features.Counter(counted, ["cases"], ["at"], None)


def test_base_panel_zero_rules(spark):
    panel, census, fires, rain, cuts, counter = base_inputs(spark)
    out = features.base_panel(panel, ["zone", "month"], number_axis(1, 4), census=census, capitals=["b"], fires=fires, rain=rain, cuts=cuts, counter=counter)
    names = ("zone", "month", "admissions", "pop", "capital", "n_fires", "fire_density", "precipitation", "area", "cases_total", "cases_new")
    got = sorted((tuple(r[c] for c in names) for r in out.collect()), key=str)
    assert got == sorted([
        ("a", 1, 5, 10, False, 1, 0.0, 5.0, 0.0, 7, 0), ("a", 2, None, 10, False, 4, 3.0, None, 1.5, 7, 0),
        ("b", 1, 7, None, True, None, None, None, 0.0, None, None), (None, 1, 9, None, False, None, None, None, 0.0, None, None),
        ("c", 9, 1, None, False, 1, 0.0, None, 0.0, None, None), ("c", 2, 1, None, False, 1, 0.0, None, 0.0, 3, 0)], key=str)
    assert set(out.columns) == {*names, "reading"}
    few = features.base_panel(panel, ["zone", "month"], number_axis(1, 4), census=census, cuts=cuts)
    assert few.count() == 6 and "n_fires" not in few.columns


def test_base_panel_is_grouped_once(spark):
    """Panel from raw rows and five features: two exchanges for the panel, two for the union, one for the census, and those
    that find the zones of named areas."""
    panel, census, fires, rain, _, counter = base_inputs(spark)
    cases = spark.createDataFrame([("a", D(2020, 1, 1), True, False, True, False, False)], "zone string, date date, confirmed boolean, undetermined boolean, symptomatic boolean, died boolean, died_confirmed boolean")
    readings = spark.createDataFrame([("a", D(2020, 1, 1), 1.0)], "zone string, date date, reading double")
    daily = panel_.daily_panel(cases, readings, "zone", "date", day_axis("2020-01-01", "2020-02-28"), threshold=1.0)
    named = spark.createDataFrame([("X", "s", 1, 2.0)], "name string, state string, month int, area double")
    names = spark.createDataFrame([("a", "x", "s")], "zone string, name string, state string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        areas = features.areas_by_zone(named, names, name="name", state="state", period="month", area="area", zone="zone")
        out = features.base_panel(panel_.roll_up(daily.withColumn("month", F.month("date")), ["zone", "month"]), ["zone", "month"], number_axis(1, 12),
                                  census=census, fires=fires, rain=rain, cuts=areas, counter=counter)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= 8 and plan.count("SortMergeJoin") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_length_of_stay_edges(spark):
    cases = spark.createDataFrame([
        ("same", False, D(2020, 8, 10), "10/08/2020", None), ("hundred", False, D(2020, 1, 8), "17/04/2020", None),
        ("long", False, D(2020, 1, 8), "18/04/2020", None), ("back", False, D(2020, 1, 8), "07/01/2020", None),
        ("closed", False, D(2020, 1, 8), None, "10/01/2020"), ("bad", False, D(2020, 1, 8), "31/02/2020", "09/01/2020"),
        ("open", False, D(2020, 1, 8), None, None), ("dead", True, D(2020, 1, 8), "09/01/2020", None),
    ], "id string, died boolean, admitted date, dt_evoluca string, dt_encerra string")
    cases = cases.withColumns({"exposed": F.date_sub("admitted", 7), "zone": F.lit("z")})
    readings = spark.createDataFrame([("z", D(2020, 1, 1), 26.0)], "zone string, exposed date, reading double")
    counter = spark.createDataFrame([("z", 1, 5)], "zone string, month int, cases_new bigint")
    out = stay.length_of_stay(cases, readings, counter, "zone", died=False).collect()
    assert {r["id"]: r["stay"] for r in out} == {"same": 0.01, "hundred": 100.0, "closed": 2.0, "bad": 1.0}
    by = {r["id"]: r for r in out}
    assert by["same"]["in_season"] and by["same"]["above"] is None and by["same"]["cases_new"] is None
    assert by["closed"]["above"] is True and by["closed"]["cases_new"] == 5
    assert [r["id"] for r in stay.length_of_stay(cases, readings, counter, "zone", died=True).collect()] == ["dead"]


def crowded_cases(spark, n):
    hot = F.col("id") % 2 == 0
    cases = spark.range(0, n, 1, 16).select(
        "id", F.when(hot, "hot").otherwise(F.concat(F.lit("z"), F.col("id") % 500)).alias("zone"), (F.col("id") % 3 == 0).alias("died"),
        F.lit(D(2020, 1, 8)).alias("admitted"), F.date_add(F.lit(D(2020, 1, 1)), (F.col("id") % 1).cast("int")).alias("exposed"),
        F.lit("10/01/2020").alias("dt_evoluca"), F.lit(None).cast("string").alias("dt_encerra"))
    zones = cases.select("zone").distinct()
    return cases, zones.select("zone", F.lit(D(2020, 1, 1)).alias("exposed"), F.lit(30.0).alias("reading")), zones.select("zone", F.lit(1).alias("month"), F.lit(5).alias("cases_new"))


def test_a_hot_zone_is_split_in_the_stay_joins(spark):
    """Half the rows share one zone and month: no task joins more than a small part of them, and every row comes back once."""
    n, conf = 40_000, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = stay.length_of_stay(*crowded_cases(spark, n), "zone", heavy=1000, salts=64)
        assert out._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") == 2
        tasks = out.groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in tasks) < n / 4 and len(tasks) == 8
        rows = out.collect()
        assert len(rows) == n and {r["id"] for r in rows} == set(range(n))
        assert all(r["above"] and r["cases_new"] == 5 for r in rows)
    finally:
        for k in conf:
            spark.conf.unset(k)


def test_stays_of_both_kinds_in_one_pass_and_no_job_when_called(spark):
    inputs = crowded_cases(spark, 900)
    spark.sparkContext.setJobGroup("stays", "built only")
    both = stay.length_of_stay(*inputs, "zone", heavy=100)
    apart = [stay.length_of_stay(*inputs, "zone", died=d) for d in (False, True)]
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("stays")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    rows = sorted(tuple(r) for r in both.select(apart[0].columns).fillna("").collect())
    assert rows == sorted(tuple(r) for a in apart for r in a.fillna("").collect()) and len(rows) == 900

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from hazeline.operators import reports


@pytest.fixture(scope="module")
def base(spark):
    rows = [("1", "A", "AC", 10, 7, 4, 2, 3), ("1", "A", "AC", 10, 8, 4, 2, 4), ("2", "B", "AC", 20, 7, 1, 0, 0),
            ("3", "C", "AM", 30, 7, 9, 5, 10), ("3", "C", "AM", 30, 1, 9, 5, 30), ("4", "D", "AM", 40, 7, 2, 1, None)]
    return spark.createDataFrame(rows, "zone string, name string, state string, pop bigint, month int, admissions bigint, confirmed bigint, days_above bigint")


def effects():
    return {"admissions": F.lit(math.log(1.026)), "confirmed": F.lit(math.log(1.02))}


KW = dict(period="month", periods=[7, 8])


def test_overall_uses_both_filters_and_the_rounded_mean(base):
    row = reports.report_overall(base, effects(), states=["AC"], text=False, **KW).first()
    assert row["mean_days"] == 2.33 and row["pct_admissions"] == pytest.approx(1.026**2.33 - 1)


def test_states_sorted_with_missing_last(base):
    got = [(r["state"], r["mean_days"], r["pct_admissions"]) for r in reports.report_states(base, effects(), **KW).collect()]
    assert got == [("AC", 2.33, "6.2%"), ("AM", None, None)]


def test_zones_and_vulnerable(base, spark):
    names = base.select("zone", "name", "state").distinct()
    zones = reports.report_zones(base, names, effects(), zone="zone", states=["AC"], **KW).collect()
    assert [(r["zone"], r["name"], r["days_above"]) for r in zones] == [("1", "A", 3.5), ("2", "B", 0.0)]
    flagged = spark.createDataFrame([("3",), ("1",)], "zone string")
    worst = reports.report_vulnerable(base, flagged, names, effects(), zone="zone", **KW).collect()
    assert [(r["zone"], r["days_above"]) for r in worst] == [("3", 10.0), ("1", 3.5)]


def test_totals_and_measures_in_the_key(base):
    rows = base.filter(F.col("month").isin(7, 8))
    keys = ["zone", "name", "state", "pop"]
    one = {r["zone"]: r for r in reports.report_totals(rows, effects(), keys).collect()}
    assert one["1"]["total_admissions"] == 8 and one["1"]["mean_days_above"] == 3.5
    assert one["1"]["pct_confirmed"] == pytest.approx(1.02**3.5 - 1) and one["4"]["pct_admissions"] is None
    twice = reports.report_totals(rows, effects(), keys, measures_in_key=True)
    assert twice.filter("zone = '1'").count() == 1  # equal rows collapse
    assert set(twice.columns) >= {"admissions", "confirmed", "total_admissions"}


def test_counterfactual(base):
    own = {(r["zone"], r["month"]): r for r in reports.counterfactual(base, effects()).collect()}
    r = own[("1", 7)]
    assert r["admissions_without"] == pytest.approx(4 / 1.026**3) and r["confirmed_without"] == pytest.approx(2 / 1.02**3)
    assert own[("2", 7)]["ratio_admissions"] == 1.0 and r["size"] == "p"
    assert all(r["admissions_without"] <= r["admissions"] for r in own.values() if r["days_above"] is not None)
    shared = reports.counterfactual(base, effects(), compat=True).filter("zone = '1' and month = 7").first()
    assert shared["confirmed_without"] == pytest.approx(2 / 1.026**3)


def test_histogram_and_reconciliation(base, spark):
    df = spark.createDataFrame([(0.0,), (-1.0,), (1.0,), (9.9,), (100.0,)], "v double")
    got = {r["bin"]: (r["n"], r["lower"]) for r in reports.log_histogram(df, "v", 1).collect()}
    assert got == {0: (2, 1.0), 2: (1, pytest.approx(100.0))}
    rec = {(r["state"], r["month"]): r["days_above"] for r in reports.source_reconciliation(base, "month", ["admissions", "days_above"]).collect()}
    assert rec[("AC", 7)] == 3 and rec[("AM", 7)] is None


def test_profile_and_season(base):
    season = reports.season_filter(base, "month", 7, 10)
    out = {r["zone"]: r["d"] for r in reports.zone_profile(season, "zone", {"days_above": "d"}, required="days_above").collect()}
    assert out == {"1": 3.5, "2": 0.0, "3": 10.0}

from __future__ import annotations

import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from hazeline.functions.dates import day_axis
from hazeline.operators import panel

RAW = ("co_mun_res string, dt_interna string, dt_evoluca string, dt_encerra string, classi_fin int, evolucao int, "
       "pos_pcrout int, febre int, tosse int, garganta int, desc_resp int, saturacao int, perd_olft int, perd_pala int")


def raw_row(**kw):
    base = dict(co_mun_res="z", dt_interna="10/02/2020", dt_evoluca=None, dt_encerra=None, classi_fin=None, evolucao=None,
                pos_pcrout=None, febre=None, tosse=None, garganta=None, desc_resp=None, saturacao=None, perd_olft=None, perd_pala=None)
    return tuple((base | kw).values())


def classify(spark, rows):
    return panel.classify_cases(spark.createDataFrame(rows, RAW), first="2020-01-01", last="2020-12-31")


def test_classification_truth_table(spark):
    domain = list(itertools.product([None, 1, 3, 4, 5], [None, 1, 2], [None, 1, 2, 9], [None, 1, 2, 9], [None, 1, 2]))
    rows = [raw_row(classi_fin=c, pos_pcrout=p, febre=f, tosse=s, evolucao=e) for c, p, f, s, e in domain]
    got = classify(spark, rows).collect()
    assert len(got) == len(domain)
    for r in got:
        c, p, e = r["classi_fin"], r["pos_pcrout"], r["evolucao"]
        undetermined, confirmed = c not in (1, 2, 3), c == 5
        suspected = confirmed or (undetermined and r["febre"] == 1 and r["tosse"] == 1)
        assert r["undetermined"] is undetermined and r["confirmed"] is confirmed
        assert r["symptomatic"] is (suspected and p != 2)
        assert r["died"] is (e == 2) and r["died_confirmed"] is (e == 2 and confirmed)
        assert r["n_symptoms"] == (1 if r["tosse"] == 1 else 0)


def test_exposure_window_is_on_the_lagged_date(spark):
    rows = [raw_row(dt_interna=d) for d in ("07/01/2020", "08/01/2020", "31/12/2020", "07/01/2021", "08/01/2021", "31/02/2020", None)]
    got = sorted(r["exposed"] for r in classify(spark, rows).collect())
    assert got == [dt.date(2020, 1, 1), dt.date(2020, 12, 24), dt.date(2020, 12, 31)]


def cases(spark):
    d = dt.date
    rows = [("a", d(2020, 1, 1), True, False, True, False, False), ("a", d(2020, 1, 1), False, True, False, True, False),
            ("a", None, True, False, True, True, True), ("b", d(2020, 2, 1), False, True, True, False, False)]
    return spark.createDataFrame(rows, "zone string, date date, " + ", ".join(f"{f} boolean" for f in panel.FLAGS))


def readings(spark):
    d = dt.date
    rows = [("a", d(2020, 1, 1), 30.0), ("a", d(2020, 1, 2), 25.0), ("c", d(2020, 1, 1), 99.0), ("a", d(2020, 1, 9), 26.0)]
    return spark.createDataFrame(rows, "zone string, date date, reading double")


def test_daily_counts_keep_null_and_off_axis_dates(spark):
    out = panel.daily_counts(cases(spark), "zone", "date", day_axis("2020-01-01", "2020-01-02"))
    got = {(r["zone"], str(r["date"])): tuple(r[c] for c in panel.COUNTS) for r in out.collect()}
    assert got == {
        ("a", "2020-01-01"): (2, 1, 1, 1, 1, 0), ("a", "2020-01-02"): (0,) * 6, ("a", "None"): (1, 1, 0, 1, 1, 1),
        ("b", "2020-01-01"): (0,) * 6, ("b", "2020-01-02"): (0,) * 6, ("b", "2020-02-01"): (1, 0, 1, 1, 0, 0),
    }


def test_daily_panel_equals_a_full_outer_join(spark):
    axis = day_axis("2020-01-01", "2020-01-02")
    got = panel.daily_panel(cases(spark), readings(spark), "zone", "date", axis)
    counts = panel.daily_counts(cases(spark), "zone", "date", axis)
    joined = counts.join(readings(spark), ["zone", "date"], "full").fillna(0, list(panel.COUNTS))
    joined = joined.withColumn("above", F.col("reading") > 25)
    assert sorted(map(str, got.select(joined.columns).collect())) == sorted(map(str, joined.collect()))
    assert got.filter("zone = 'c'").count() == 1  # readings alone do not complete a zone


def test_threshold_is_strict_and_null_stays_null(spark):
    rows = {(r["zone"], str(r["date"])): r["above"] for r in panel.daily_panel(
        cases(spark), readings(spark), "zone", "date", day_axis("2020-01-01", "2020-01-03")).collect()}
    assert rows[("a", "2020-01-01")] is True and rows[("a", "2020-01-02")] is False and rows[("a", "2020-01-03")] is None


@pytest.mark.parametrize("skip, mean", [(False, None), (True, 27.0)])
def test_monthly_mean_propagates_or_skips_but_days_above_always_propagate(spark, skip, mean):
    daily = panel.daily_panel(cases(spark), readings(spark), "zone", "date", day_axis("2020-01-01", "2020-01-03"))
    row = panel.monthly_panel(daily, "zone", "date", skip_missing=skip).filter("zone = 'a' and month = 1").first()
    assert row["reading"] == mean and row["days_above"] is None and row["admissions"] == 2


def test_pooling_years_drops_the_year(spark):
    daily = panel.daily_panel(cases(spark), readings(spark), "zone", "date", day_axis("2019-01-01", "2020-01-31"))
    apart, pooled = (panel.monthly_panel(daily, "zone", "date", pool_years=p) for p in (False, True))
    assert "year" in apart.columns and "year" not in pooled.columns
    total = lambda df: df.agg(F.sum("admissions")).first()[0]
    assert total(apart) == total(pooled) == 4


def test_semi_filter_by_table(spark):
    zones = spark.createDataFrame([("a",), ("a",), ("q",)], "code string")
    assert panel.in_zones(readings(spark), "zone", zones, "code").count() == 3


def test_monthly_mean(spark):
    got = panel.monthly_mean(readings(spark), "zone", "date", "reading").filter("zone = 'a'").first()
    assert (got["year"], got["month"], got["reading_mean"]) == (2020, 1, 27.0)

from __future__ import annotations

import datetime as dt
import unicodedata

import pytest
from pyspark.sql import functions as F

from hazeline.functions import dates, effects, nulls, text


def one(df):
    return [r[0] for r in df.collect()]


def test_propagating_and_skipping_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 1.0), ("b", None), ("c", None)], "g string, x double")
    got = {r["g"]: r for r in df.groupBy("g").agg(
        nulls.na_mean("x").alias("m"), nulls.na_sum("x").alias("s"), nulls.skip_mean("x").alias("k")).collect()}
    assert (got["a"]["m"], got["a"]["s"], got["a"]["k"]) == (2.0, 4.0, 2.0)
    assert (got["b"]["m"], got["b"]["s"], got["b"]["k"]) == (None, None, 1.0)
    assert (got["c"]["m"], got["c"]["s"], got["c"]["k"]) == (None, None, None)


def test_null_rules_of_single_values(spark):
    df = spark.createDataFrame([(1,), (-2,), (0,), (None,)], "x int")
    out = df.select(
        nulls.in_set("x", [1, 2]).alias("in"), nulls.coded_yes("x").alias("yes"), nulls.clamp_negative("x").alias("clamp"),
        nulls.replace_zero("x", 9).alias("nz"), nulls.exceeds("x", 0).alias("above")).collect()
    assert [r["in"] for r in out] == [True, False, False, False]
    assert [r["yes"] for r in out] == [True, False, False, False]
    assert [r["clamp"] for r in out] == [1, 0, 0, None]
    assert [r["nz"] for r in out] == [1, -2, 9, None]
    assert [r["above"] for r in out] == [True, False, False, None]


def test_readings_drop_null_nan_and_text_nan(spark):
    df = spark.createDataFrame([("1.5",), ("NaN",), (None,), ("x",)], "v string")
    assert one(df.select(F.col("v").try_cast("double").alias("v")).filter(nulls.is_reading("v"))) == [1.5]


def test_fill_null_keeps_types(spark):
    df = nulls.fill_null(spark.createDataFrame([(None, None)], "a bigint, b double"), {"a": 0, "b": 0})
    assert df.dtypes == [("a", "bigint"), ("b", "double")] and tuple(df.first()) == (0, 0.0)


def test_bad_dates_become_null(spark):
    df = spark.createDataFrame([("31/12/2020", "12/31/2020"), ("31/02/2020", "2/30/2020"), (None, None)], "d string, m string")
    out = df.select(dates.parse_dmy("d"), dates.parse_mdy("m")).collect()
    assert tuple(out[0]) == (dt.date(2020, 12, 31), dt.date(2020, 12, 31))
    assert tuple(out[1]) == tuple(out[2]) == (None, None)


def test_local_clock_can_fall_on_the_day_before(spark):
    df = spark.sql("select timestamp_ntz'2020-01-01 03:00:00' ts").select(dates.shift_hours("ts", -5).alias("l"))
    row = df.select(dates.clock("l"), F.to_date("l")).first()
    assert tuple(row) == ("22:00:00", dt.date(2019, 12, 31))


@pytest.mark.parametrize("raw, clean", [
    ("0_precipitation", "x0_precipitation"), ("View Date", "view_date"), ("Município", "municipio"),
    ("area (km²)", "area_km2"), ("CO_MUN_RES", "co_mun_res"), ("viewDate", "view_date"),
])
def test_clean_name(raw, clean):
    assert text.clean_name(raw) == clean


def test_clean_names_separates_repeats(spark):
    assert text.clean_names(spark.createDataFrame([(1, 2, 3)], "`a b` int, `a-b` int, c int")).columns == ["a_b", "a_b_2", "c"]


def test_text_keys(spark):
    df = spark.createDataFrame([(1234567, "São João", "x10_rain")], "c bigint, n string, h string")
    row = df.select(text.zone_code("c"), text.name_key("n"), text.leading_number("h")).first()
    assert tuple(row) == ("123456", "SAO JOAO", 10)
    assert one(df.select(text.leading_number(F.lit("none")))) == [None]
    assert all(len(v) == 1 for v in text.PLAIN_LETTERS.values())


def test_effects(spark):
    df = spark.createDataFrame([(0.0,), (3.0,), (None,)], "d double")
    b = F.log(F.lit(1.02))
    out = df.select(effects.rate_ratio(b, "d").alias("r"), effects.percent_text(effects.extra_share(b, "d")).alias("t")).collect()
    assert out[0]["r"] == 1.0 and out[0]["t"] == "0.0%"
    assert out[1]["r"] == pytest.approx(1.02**3) and out[1]["t"] == "6.1%"
    assert out[2]["r"] is None and out[2]["t"] is None


def test_half_up_mean_is_exact_on_ties(spark):
    # 23/40 = 0.575: the stored double lies below the tie.
    df = spark.range(40).select("id", F.when(F.col("id") < 23, 1).otherwise(0).alias("x"))
    assert one(df.agg(effects.half_up_mean("x"))) == [0.58]
    assert one(df.withColumn("x", F.when(F.col("id") > 0, F.col("x"))).agg(effects.half_up_mean("x"))) == [None]


def test_coefficient_lookup_and_sizes(spark):
    table = spark.createDataFrame([("m", "days", 0.1), ("m", "pm", -0.2), ("n", "days", 0.3)], "model string, term string, estimate double")
    got = spark.range(1).select(effects.coefficient(table, "m", "days").alias("b")).first()["b"]
    assert got == 0.1
    sized = {(r["model"], r["term"]): r for r in effects.effect_sizes(table).collect()}
    assert sized[("m", "pm")]["decrease"] == pytest.approx(0.18127, abs=1e-5)
    wide = effects.coefficients_wide(table, ["days", "pm"]).orderBy("model").collect()
    assert tuple(wide[0]) == ("m", 0.1, -0.2) and wide[1]["pm"] is None


def test_any_accent_folds(spark):
    spelt = ["São Luís", "Ærø", "Åre", "Ýmir", "Łódź", "ǟ", "Việt", "e\u0301te\u0301", "a\u0328\u0301", "Ñandú", None, "", "Καλημέρα"]
    got = [r["f"] for r in spark.createDataFrame([(i, s) for i, s in enumerate(spelt)], "i int, s string").orderBy("i").select(text.fold_accents("s").alias("f")).collect()]
    assert got[:10] == ["Sao Luis", "Ærø", "Are", "Ymir", "Łodz", "a", "Viet", "ete", "a", "Nandu"] and got[10:12] == [None, ""]
    for s, f in zip(spelt, got):
        if s:
            plain = "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))
            assert f == plain

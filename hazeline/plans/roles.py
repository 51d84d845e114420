"""Test tables in the roles the operators expect.

The tables hold orders and events rather than admissions and readings, so each role is a plain projection of one
of them.  Amounts become whole cents: their sums do not depend on the order rows are added in.  Codes, missing
values and misspellings, which the tables lack, are derived from each row's own key; every row takes part.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeline.functions.dates import number_axis, parse_mdy
from hazeline.functions.nulls import na_mean
from hazeline.functions.text import clean_names
from hazeline.operators import cluster, features, panel, reports, zonal
from hazeline.operators.countmodel import CountFit
from hazeline.operators.features import census_dimension
from hazeline.operators.grid_fill import observed_range

CASE_TYPES = ("error", "purchase")
THRESHOLD = 5000.0
WEEKS = (0, 4)
MONTHS = (1, 12)
CAPITALS = ("3", "14", "15", "92", "65", "35", "89", "79", "32")
SEASON = (1, 2, 3)
LAST_WEEK = (4,)
STATES = tuple(f"NATION_{i}" for i in range(10))
# Published effects per day above the threshold, +2.6 % (all admissions) and +2.0 % (confirmed).
EFFECTS = {"admissions": 1.026, "confirmed": 1.020}
PROFILE = ("admissions", "reading", "days_above", "precipitation", "area", "pop", "n_fires")


@lru_cache(maxsize=64)
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; kept per session, so a query using it several times lists and reads its footers once."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100)


def text(c: str) -> Column:
    return F.col(c).cast("string")


def effects() -> dict[str, Column]:
    return {r: F.log(F.lit(ratio)) for r, ratio in EFFECTS.items()}


def week_of(date: str) -> Column:
    return ((F.dayofmonth(date) - 1) / 7).cast("int")


# events: readings, cases, counters and grid bands ----------------------------------------------------------


def event_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(text("user_id").alias("zone"), F.to_date("ts").alias("date"), cents("value").alias("reading"))


def event_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").filter(F.col("event_type").isin(*CASE_TYPES))
    confirmed = F.col("event_type") == "purchase"
    died = F.col("value") < 10
    return ev.select(
        text("user_id").alias("zone"), F.to_date("ts").alias("date"), confirmed.alias("confirmed"),
        (~confirmed).alias("undetermined"), (confirmed | (F.col("value") > 50)).alias("symptomatic"),
        died.alias("died"), (died & confirmed).alias("died_confirmed"),
    )


def event_daily_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, readings = event_cases(spark, sf_dir), event_readings(spark, sf_dir)
    return panel.daily_panel(cases, readings, "zone", "date", observed_range(cases, "date"), threshold=THRESHOLD)


def event_weekly_panel(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    daily = event_daily_panel(spark, sf_dir).withColumn("week", week_of("date"))
    return panel.roll_up(daily, ["zone", "week"], **kw)


def event_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").filter(F.col("event_type") == "purchase")
    deaths = F.regexp_extract("props", r"(\d+)", 1).cast("bigint")
    return ev.select(
        text("user_id").alias("zone"), F.to_date("ts").alias("date"), "ts", "event_id",
        cents("value").cast("bigint").alias("cases"), deaths.alias("deaths"),
    )


COUNTED = dict(first="2023-12-18", last="2024-01-16")


def counter_week() -> Column:
    return (F.datediff("date", F.lit(COUNTED["first"]).cast("date")) / 7).cast("int")


def event_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.counter_increments(
        event_counter(spark, sf_dir), "zone", "date", ["cases", "deaths"], **COUNTED, period=counter_week(),
        axis=number_axis(*WEEKS), order=["ts", "event_id"], reset_first=0,
    ).withColumnRenamed("period", "week")


def fire_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").filter(F.col("event_type") == "click")
    return ev.select(text("user_id").alias("zone"), week_of("ts").alias("week"), F.lit(1).alias("n_fires"),
                     cents("value").alias("fire_density"))


def rain_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").filter(F.col("event_type") == "view")
    return ev.select(text("user_id").alias("zone"), week_of("ts").alias("week"), cents("value").alias("precipitation"))


def cut_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.areas_by_zone(
        cuts(spark, sf_dir).withColumn("week", week_of("seen")), census(spark, sf_dir).select("zone", "name", "state"),
        name="name", state="state", period="week", area="area", zone="zone",
    )


def counter_of_weeks(spark: SparkSession, sf_dir: str) -> features.Counter:
    rows = features.counter_rows(event_counter(spark, sf_dir), "date", **COUNTED, period=counter_week())
    return features.Counter(rows.withColumnRenamed("period", "week"), ["cases", "deaths"], ["ts", "event_id"], 0)


def grid_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event is a reading of the cell (user mod 10, user div 10) in a 3-hourly band."""
    ev = table(spark, sf_dir, "events")
    band = F.col("ts") - F.make_dt_interval(F.lit(0), F.hour("ts") % 3, F.minute("ts"), F.extract(F.lit("SECOND"), "ts"))
    return ev.select(
        "event_id", F.col("ts").alias("run_ts"), band.alias("band_ts"),
        (F.col("user_id") % 10).alias("cell_x"), F.floor(F.col("user_id") / 10).alias("cell_y"),
        (cents("value") * F.lit(1e-9)).alias("value"),
    )


# supplier: polygons over that grid -------------------------------------------------------------------------


def polygon_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A concave pentagon per supplier, with a hole where the balance is above 6000; its place and size follow key and balance."""
    a = F.col("s_acctbal") / 10000
    s = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("polygon"),
        ((F.col("s_suppkey") * 7) % 10 + 0.5 + a / 3).alias("cx"), (F.col("s_suppkey") * 0.15 + a / 7).alias("cy"),
        (0.8 + a * 0.9).alias("r"), (F.col("s_acctbal") > 6000).alias("holed"),
    )

    def ring(*corners):
        return F.array(*[F.struct((F.col("cx") + F.col("r") * x).alias("x"), (F.col("cy") + F.col("r") * y).alias("y"))
                         for x, y in corners])

    outer = ring((-1.0, -0.7), (0.13, -0.31), (1.0, -0.9), (0.77, 0.83), (-0.6, 1.1))
    hole = ring((-0.17, 0.1), (-0.15, 0.41), (0.19, 0.37), (0.17, 0.12))
    rings = F.array(F.struct(F.lit(0).alias("ring_id"), outer.alias("points")),
                    F.struct(F.lit(1).alias("ring_id"), hole.alias("points")))
    kept = F.filter(rings, lambda g: (g["ring_id"] == 0) | F.col("holed"))
    return s.select("polygon", F.inline(kept))


def polygon_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zonal.ring_edges(polygon_rings(spark, sf_dir), ["polygon"])


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("polygon"), text("s_nationkey").alias("zone"))


# orders and lineitem: coded line list ------------------------------------------------------------------------


def line_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as coded admissions; the last shipment is the outcome date."""
    lines = table(spark, sf_dir, "lineitem")
    shipped = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("shipped"))
    return coded(table(spark, sf_dir, "orders").join(shipped, "o_orderkey", "left"), F.col("shipped"))


def line_list_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same line list before any outcome is known: orders alone."""
    return coded(table(spark, sf_dir, "orders"), F.lit(None).cast("timestamp_ntz"))


def coded(orders: DataFrame, shipped: Column) -> DataFrame:
    k, urgency = F.col("o_orderkey"), F.substring("o_orderpriority", 1, 1).cast("int")

    def when(*pairs, other=None):
        out = F.when(*pairs[0])
        for p in pairs[1:]:
            out = out.when(*p)
        return out.otherwise(other)

    dmy = lambda d: F.date_format(d, "dd/MM/yyyy")
    return orders.select(
        "o_orderkey", text("o_custkey").alias("zone"), F.col("o_totalprice").alias("price"),
        F.when(F.col("o_totalprice") < 5000, "31/02/1999").otherwise(dmy("o_orderdate")).alias("dt_interna"),
        F.when(urgency != 5, dmy(shipped)).alias("dt_evoluca"),
        dmy(shipped).alias("dt_encerra"),
        when((k % 11 == 0, None), ((k % 11).isin(1, 2, 3), 5), (k % 11 == 4, 4),
             other=F.instr(F.lit("FOP"), F.col("o_orderstatus"))).alias("classi_fin"),
        when((F.col("o_orderstatus") == "F", 2), (F.col("o_orderstatus") == "O", 1)).alias("evolucao"),
        when((k % 5 == 1, 2), ((k % 5).isin(2, 3), 1)).alias("pos_pcrout"),
        when((urgency <= 2, 1), (urgency == 3, 2), (urgency == 4, 9)).alias("febre"),
        when((k % 2 == 0, 1), other=2).alias("tosse"),
        when((k % 3 == 0, 1), other=9).alias("garganta"),
        when((k % 7 == 0, 1)).alias("desc_resp"),
        when((urgency == 1, 1), other=2).alias("saturacao"),
        when((k % 13 == 1, 1)).alias("perd_olft"),
        when((k % 17 == 0, 1), other=2).alias("perd_pala"),
    )


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.classify_cases(line_list(spark, sf_dir), first="1995-01-01", last="2001-12-31")


def order_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(text("o_custkey").alias("zone"), F.to_date("o_orderdate").alias("exposed"),
                    cents("o_totalprice").alias("reading"))


def order_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly cumulative and new cases per customer, all years pooled."""
    o = table(spark, sf_dir, "orders").select(
        text("o_custkey").alias("zone"), F.to_date("o_orderdate").alias("date"), "o_orderkey",
        cents("o_totalprice").cast("bigint").alias("cases"))
    return features.counter_increments(
        o, "zone", "date", ["cases"], first="1994-12-01", last="2001-12-31", period=F.month("date"), axis=number_axis(*MONTHS),
        order=["date", "o_orderkey"],
    ).withColumnRenamed("period", "month")


# customer: census and names ---------------------------------------------------------------------------------


def population() -> Column:
    """The balance stands for the population; below zero it is unknown."""
    return F.when(F.col("c_acctbal") >= 0, F.floor("c_acctbal").cast("bigint"))


def census_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two census years per customer; the population is unknown for some."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("state"))
    c = table(spark, sf_dir, "customer").join(nation, "c_nationkey")
    return c.select(
        text("c_custkey").alias("zone"), F.explode(F.array(F.lit("2000"), F.lit("2010"))).alias("year"),
        F.col("c_name").alias("name"), "state", (F.col("c_acctbal") / 10000).alias("idhm"),
        (F.col("c_custkey") % 20 + 60).cast("double").alias("espvida"), F.col("c_acctbal").alias("rdpc"),
        ((F.col("c_custkey") % 100) / 100).cast("double").alias("gini"), population().alias("pop"),
    )


def census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return census_dimension(census_years(spark, sf_dir), "2010", small=2500, medium=5000)


def misspelt(name: Column, accented: Column, unknown: Column) -> Column:
    """Accented lower-case spelling, and a name no dimension knows."""
    spelt = F.when(accented, F.translate(F.lower(name), "aeou", "áéõü")).otherwise(name)
    return F.when(unknown, F.concat(spelt, F.lit(" ?"))).otherwise(spelt)


def cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as clear-cut reports that name their zone only in free text."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("state"))
    o = table(spark, sf_dir, "orders").join(c, "o_custkey").join(n, "c_nationkey")
    seen = parse_mdy(F.date_format("o_orderdate", "M/d/yyyy"))
    name = misspelt(F.col("c_name"), F.col("o_orderpriority") < "3", F.col("o_totalprice") > 480000)
    return o.select(name.alias("name"), "state", seen.alias("seen"),
                    cents("o_totalprice").alias("area"))


def cut_area(spark: SparkSession, sf_dir: str, period: str, of_date: Column, axis: Column) -> DataFrame:
    return features.area_by_name(
        cuts(spark, sf_dir).withColumn(period, of_date), census(spark, sf_dir).select("zone", "name", "state"),
        name="name", state="state", month=period, axis=axis, area="area", zone="zone",
    )


FEATURES = {"fires": fire_rows, "counter": counter_of_weeks, "rain": rain_rows, "cuts": cut_rows}


def event_base_panel(spark: SparkSession, sf_dir: str, features_: tuple[str, ...] = tuple(FEATURES)) -> DataFrame:
    """Weekly panel with census and the named features; a report asks only for what it shows."""
    return features.base_panel(
        event_weekly_panel(spark, sf_dir), ["zone", "week"], number_axis(*WEEKS), census=census(spark, sf_dir), capitals=CAPITALS,
        **{f: FEATURES[f](spark, sf_dir) for f in features_},
    )


def monitored(base: DataFrame) -> DataFrame:
    """The panel as states report it: those with an even number send only zones whose last week is whole, the others all."""
    last = base.filter(F.col("week").isin(*LAST_WEEK))
    whole = last.groupBy("zone").agg(F.count_if(F.col("days_above").isNull()).alias("holes")).filter("holes = 0")
    return base.filter(F.col("state").rlike("[02468]$")).join(whole.select("zone"), "zone", "left_semi").unionByName(
        base.filter(~F.col("state").rlike("[02468]$")))


def flagged_zones(base: DataFrame) -> DataFrame:
    """Zones with at least two days above per season week, by their own mean."""
    rows = reports.season_filter(base, "week", min(SEASON), max(SEASON))
    return rows.groupBy("zone").agg(na_mean("days_above").alias("d")).filter(F.col("d") >= 2).select("zone")


# orders: zone profiles and count-model rows ---------------------------------------------------------------------


def order_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zone x year x month panel with the seven profile measures."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("quantity"))
    o = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left").withColumnRenamed("o_custkey", "c_custkey")
    monthly = o.groupBy("c_custkey", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(
        F.count(F.lit(1)).alias("admissions"), F.avg(cents("o_totalprice")).alias("reading"),
        F.count_if(F.col("o_totalprice") > 300000).alias("days_above"), F.sum("quantity").alias("precipitation"),
        F.sum(F.coalesce("n_lines", F.lit(0))).alias("n_fires"), F.max(cents("o_totalprice")).alias("area"),
    )
    c = table(spark, sf_dir, "customer").select("c_custkey", cents("c_acctbal").alias("pop"))
    return monthly.join(c, "c_custkey").withColumn("zone", text("c_custkey")).drop("c_custkey")


def order_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    season = reports.season_filter(order_months(spark, sf_dir), "month", 7, 10)
    return reports.zone_profile(season, "zone", {c: c for c in PROFILE}, required="precipitation")


def count_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipped quantity per customer and year, an over-dispersed count, with orders as exposure."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum("l_quantity").alias("quantity"))
    o = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left")
    yearly = o.groupBy(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("year")).agg(
        F.sum(F.coalesce("quantity", F.lit(0.0))).alias("shipped"), F.count(F.lit(1)).alias("orders"),
        (F.avg("o_totalprice") / 100000).alias("price"))
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 1000).alias("balance"),
                                                F.col("c_mktsegment").alias("segment"))
    return yearly.join(c, "c_custkey")


#: A count model with round coefficients, for what can be computed without fitting.
GIVEN = CountFit(None, {"(Intercept)": 4.5, "balance": 0.01, "price": 0.05, "segmentBUILDING": -0.1, "segmentFURNITURE": 0.05,
                        "segmentHOUSEHOLD": 0.02, "segmentMACHINERY": -0.03}, 6.0, 0.0, 0.0, 0.0, "orders")
#: Three cluster centres on standardised profiles.
CENTERS = ((0.5, 0.25, 0.5, 0.25, 0.5, 0.0, 0.5), (-0.5, -0.25, -0.5, -0.25, -0.5, 0.0, -0.5), (0.0, 1.0, 0.0, 0.0, 1.0, 1.5, 0.0))
#: Centres of a stored clustering of the weekly panel, by admissions, reading and days above.
WARNED = ("admissions", "reading", "days_above")
STORED_CENTERS = ((1.0, 0.5, 1.0), (0.0, 0.0, 0.0), (-1.0, -0.5, -1.0))


def warned_zones(spark: SparkSession, base: DataFrame) -> DataFrame:
    """Zones of the most exposed cluster: the last week's profiles against a stored clustering."""
    kept = cluster.centers_table(spark, np.array(STORED_CENTERS), WARNED)
    profile = reports.zone_profile(base.filter(F.col("week").isin(*LAST_WEEK)), "zone", {c: c for c in WARNED}, required="reading")
    return cluster.zones_of_worst(cluster.standardize(profile, list(WARNED)), "zone", list(WARNED), cluster.load_centers(kept, list(WARNED)))

"""One query per operator, over whole tables.  Doubles are rounded to 6 digits, which absorbs summation order."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeline.functions import dates, effects, nulls
from hazeline.functions import text as tx
from hazeline.operators import cluster, countmodel, features, grid_fill, manylevels, panel, raster, reports, stay, zonal
from hazeline.operators.loops import checkpointed
from hazeline.plans import roles
from hazeline.plans.roles import cents, table, text
from hazeline.sources.resume import pending

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def tidy(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Chosen columns, doubles rounded."""
    kind = dict(df.dtypes)
    return df.select(*[F.round(c, digits).alias(c) if kind[c] == "double" else F.col(c) for c in columns or df.columns])


# scans, predicates, keys -------------------------------------------------------------------------------------


@query
def scan_drop_cols(spark, d):
    raw = table(spark, d, "lineitem")
    raw = raw.toDF(*[c.replace("l_", "L ").title() for c in raw.columns])
    return tx.clean_names(raw).drop("l_tax", "l_linestatus", "l_returnflag")


@query
def incremental_anti(spark, d):
    ev = table(spark, d, "events").select(text("user_id").alias("zone"), F.to_date("ts").alias("date"), "event_type")
    return pending(ev, ev.filter(F.col("event_type") == "view"), ["zone", "date"])


@query
def clean_readings(spark, d):
    text_value = F.round(F.col("value"), 2).cast("string")
    raw = F.when(F.col("event_type") == "error", None).when(F.col("value") > 300, "NaN").otherwise(text_value)
    ev = table(spark, d, "events").select("event_id", raw.alias("ppm25"))
    return panel.clean_readings(ev, "ppm25").select("event_id", "reading")


@query
def semi_zone_filter(spark, d):
    chosen = table(spark, d, "customer").filter(F.col("c_mktsegment") == "BUILDING")
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("zone"), "o_totalprice")
    return panel.in_zones(orders, "zone", chosen, "c_custkey")


@query
def distinct_zones(spark, d):
    return table(spark, d, "customer").select("c_mktsegment").distinct().orderBy("c_mktsegment")


@query
def zone_surrogate_id(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    return grid_fill.surrogate_id(c, "c_custkey")


@query
def exceedance_flag(spark, d):
    value = F.when(F.col("event_type") != "error", F.col("value"))
    return table(spark, d, "events").select("event_id", nulls.exceeds(value, 50.0).alias("above"))


@query
def string_keys(spark, d):
    c = table(spark, d, "customer")
    name = roles.misspelt(F.col("c_name"), F.col("c_mktsegment") < "G", F.col("c_acctbal") < 0)
    check = F.concat(F.lpad(text("c_custkey"), 9, "0"), (F.col("c_custkey") % 10).cast("string"))
    return c.select(
        "c_custkey", tx.zone_code(check, 9).alias("zone"), tx.zone_code(F.col("c_custkey") + 1000000).alias("zone6"),
        F.concat_ws("_", F.lit("ymd"), "c_mktsegment", "c_nationkey").alias("label"),
        F.split("c_name", "#")[1].alias("part"), (tx.leading_number("c_name") + 1).alias("number"),
        tx.name_key(name).alias("name_key"), F.regexp_replace("c_name", "0+", "_").alias("squeezed"),
        F.replace("c_mktsegment", F.lit("U"), F.lit("-")).alias("replaced"),
        text("c_nationkey").try_cast("double").alias("nation_number"),
        F.col("c_mktsegment").try_cast("double").alias("not_a_number"),
    )


@query
def date_parts(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "31/02/1999")
        .otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("dmy"),
        F.date_format("o_orderdate", "M/d/yyyy").alias("mdy"),
        (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), (k % 24).cast("int"))).alias("ts"),
    )
    day = dates.parse_mdy("mdy")
    local = dates.shift_hours("ts", -5)
    return o.select(
        "o_orderkey", dates.parse_dmy("dmy").alias("parsed"), day.alias("day"), F.year(day).alias("year"),
        F.month(day).alias("month"), dates.lagged(day, 7).alias("exposed"), dates.lagged(day, 14).alias("reported"),
        F.datediff(day, F.lit("1995-01-01").cast("date")).alias("days"), dates.clock(local).alias("clock"),
        F.to_date(local).alias("local_date"), F.size(dates.day_axis(F.trunc(day, "month"), F.last_day(day))).alias("month_days"),
    )


@query
def clamp_values(spark, d):
    x = F.when(F.col("o_orderstatus") != "P", F.floor(F.col("o_totalprice") / 1000) - 250).cast("bigint")
    y = F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.substring("o_orderpriority", 1, 1).cast("bigint") - 1)
    o = table(spark, d, "orders").select("o_orderkey", x.alias("x"), y.alias("y"))
    out = o.withColumns({
        "clamped": nulls.clamp_negative("x"), "at_least_one": nulls.replace_zero("x", 1),
        "not_zero": nulls.replace_zero(F.col("y").cast("double"), 0.01), "either": F.coalesce("x", "y"),
        "filled": F.col("y"),
    })
    return nulls.fill_null(out, {"filled": 0})


@query
def rate_ratio(spark, d):
    b = F.log(F.lit(1.026))
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", (F.col("o_orderkey") % 31).alias("days"))
    out = o.withColumns({
        "ratio": effects.rate_ratio(b, "days"), "extra": effects.extra_share(b, "days"),
        "offset": F.when(F.col("o_totalprice") > 0, F.log("o_totalprice")),
    })
    return tidy(out.withColumn("shown", effects.percent_text("extra")), "o_orderkey", "days", "ratio", "extra", "shown", "offset")


@query
def classify_cases(spark, d):
    cases = panel.classify_cases(roles.line_list_open(spark, d), first="1995-01-01", last="2001-12-31")
    return cases.select("o_orderkey", "zone", "exposed", "n_symptoms", *panel.FLAGS)


# grids and panels ----------------------------------------------------------------------------------------------


@query
def daily_counts(spark, d):
    cases = roles.event_cases(spark, d)
    return panel.daily_counts(cases, "zone", "date", grid_fill.observed_range(cases, "date"))


@query
def daily_counts_by_outcome(spark, d):
    axis = dates.day_axis("1998-01-01", "1998-12-31")
    return panel.daily_counts(roles.classified(spark, d), "zone", "outcome_date", axis)


@query
def complete_observed_range(spark, d):
    ev = roles.event_readings(spark, d)
    return grid_fill.complete(ev, ["zone"], "date", grid_fill.observed_range(ev, "date"), {"reading": 0})


@query
def complete_fixed_range(spark, d):
    ev = roles.event_readings(spark, d)
    axis = dates.day_axis("2024-01-05", "2024-02-04")
    aggs = {"n": F.count(F.lit(1)), "total": F.sum("reading")}
    return grid_fill.aggregate_on_grid(ev, ["zone"], "date", axis, aggs, {"n": 0})


@query
def complete_months(spark, d):
    zone = F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", text("o_custkey"))
    o = table(spark, d, "orders").select(zone.alias("zone"), F.month("o_orderdate").alias("month"),
                                         F.lit(1).alias("n_fires"), cents("o_totalprice").alias("fire_density"))
    return features.complete_months(o, "zone", "month", dates.number_axis(*roles.MONTHS), ["n_fires", "fire_density"])


@query
def daily_panel(spark, d):
    return tidy(roles.event_daily_panel(spark, d))


@query
def monthly_panel(spark, d):
    return tidy(roles.event_weekly_panel(spark, d))


@query
def outcome_monthly_panel(spark, d):
    cases = roles.classified(spark, d).withColumn("date", F.col("outcome_date"))
    readings = roles.order_readings(spark, d).withColumnRenamed("exposed", "date")
    axis = dates.day_axis("1998-01-01", "1998-12-31")
    daily = panel.daily_panel(cases, readings, "zone", "date", axis, threshold=25000000.0)
    return tidy(panel.monthly_panel(daily, "zone", "date", pool_years=True, skip_missing=True))


@query
def monthly_mean(spark, d):
    return tidy(panel.monthly_mean(roles.order_readings(spark, d), "zone", "exposed", "reading"))


def _discounts(spark, d):
    li = table(spark, d, "lineitem")
    x = F.when(F.col("l_discount") > 0, cents("l_discount"))
    return li.select(F.col("l_suppkey").alias("zone"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"),
                     x.alias("x")).groupBy("zone", "year", "month")


@query
def na_propagating_agg(spark, d):
    return tidy(_discounts(spark, d).agg(nulls.na_mean("x").alias("mean_x"), nulls.na_sum("x").alias("sum_x")))


@query
def na_skipping_agg(spark, d):
    return tidy(_discounts(spark, d).agg(nulls.skip_mean("x").alias("mean_x"), F.sum("x").alias("sum_x")))


# length of stay, counters, features ------------------------------------------------------------------------------


def _stay(spark, d, died):
    readings = roles.order_readings(spark, d).groupBy("zone", "exposed").agg(F.avg("reading").alias("reading"))
    out = stay.length_of_stay(roles.classified(spark, d), readings, roles.order_counter(spark, d), "zone", died=died,
                              threshold=25000000.0)
    return tidy(out, "o_orderkey", "zone", "exposed", "month", "admitted", "ended", "stay", "in_season", "reading",
                "above", "cases_total", "cases_new")


@query
def length_of_stay(spark, d):
    return _stay(spark, d, False)


@query
def length_of_stay_fatal(spark, d):
    return _stay(spark, d, True)


@query
def last_in_period(spark, d):
    c = roles.event_counter(spark, d).withColumn("week", roles.week_of("date"))
    c = c.withColumn("cases", F.when(F.col("cases") >= 1000, F.col("cases")))
    return features.last_in_period(c, ["zone", "week"], ["ts", "event_id"], ["cases", "deaths"])


@query
def fill_down(spark, d):
    c = roles.event_counter(spark, d).withColumn("week", roles.week_of("date"))
    newest = {v: F.max_by(v, F.struct("ts", "event_id")) for v in ("cases", "deaths")}
    dense = grid_fill.aggregate_on_grid(c, ["zone"], "week", dates.number_axis(*roles.WEEKS), newest)
    return grid_fill.fill_down(dense, "zone", "week", ["cases", "deaths"])


@query
def cumulative_to_increment(spark, d):
    return roles.event_increments(spark, d)


@query
def clearing_monthly(spark, d):
    return roles.cut_area(spark, d, "month", F.month("seen"), dates.number_axis(*roles.MONTHS))


@query
def accent_join(spark, d):
    p = table(spark, d, "part")
    named = p.select("p_partkey", F.translate("p_name", "aeou", "áéõü").alias("name"), "p_type")
    sizes = p.groupBy(F.upper("p_name").alias("name"), "p_type").agg(F.count(F.lit(1)).alias("n"))
    return features.join_on_name(named, sizes, "name", ["p_type"])


@query
def unpivot_months(spark, d):
    o = table(spark, d, "orders").select(text("o_custkey").alias("code"), (F.month("o_orderdate") - 1).alias("m"),
                                         cents("o_totalprice").alias("v"))
    wide = o.groupBy("code").pivot("m", list(range(12))).agg(F.sum("v"))
    wide = tx.clean_names(wide.toDF("code", *[f"{i}_precipitation" for i in range(12)]))
    return features.unpivot_months(wide, "code", r"^x\d+_precipitation$", "precipitation").orderBy("code", "month")


@query
def unpivot_stat_dates(spark, d):
    days = [f"2024-01-{i:02d}" for i in range(1, 32)]
    ev = roles.event_readings(spark, d).withColumn("day", text("date"))
    wide = ev.groupBy("zone").pivot("day", days).agg(F.avg("reading").alias("mean"), F.max("reading").alias("max"))
    labels = [f"{fun}.X{day.replace('-', '.')}" for day in days for fun in ("mean", "max")]
    return tidy(features.unpivot_stat_dates(wide.toDF("zone", *labels), ["zone"], "ppm25"))


@query
def dim_census(spark, d):
    return tidy(roles.census(spark, d).withColumn("capital", features.capital_flag("zone", roles.CAPITALS)))


@query
def size_band(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", roles.population().alias("pop")).withColumn("size", features.size_band("pop", 2500, 5000))


@query
def base_panel(spark, d):
    return tidy(roles.event_base_panel(spark, d))


@query
def season_filter(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.month("o_orderdate").alias("month"), "o_totalprice")
    return reports.season_filter(o, "month", 7, 10)


@query
def zone_profile(spark, d):
    return tidy(roles.order_profile(spark, d))


# grid ------------------------------------------------------------------------------------------------------------


@query
def grid_consolidate(spark, d):
    g = raster.consolidate(roles.grid_bands(spark, d))
    return tidy(g, "event_id", "cell_x", "cell_y", "band", "date_utc", "date_local", "value")


def _daily_grid(spark, d, **kw):
    return raster.daily_mean(raster.consolidate(roles.grid_bands(spark, d)), **kw)


@query
def grid_daily_mean(spark, d):
    return tidy(_daily_grid(spark, d))


@query
def grid_daily_mean_latest_run(spark, d):
    return tidy(_daily_grid(spark, d, day_basis="local", dedupe="latest_run"))


@query
def zone_cell_coverage(spark, d):
    return tidy(zonal.coverage(roles.polygon_edges(spark, d), "polygon"))


def _polygon_stats(spark, d):
    cover = zonal.coverage(roles.polygon_edges(spark, d), "polygon")
    return zonal.zonal_stats(checkpointed(_daily_grid(spark, d)), cover, "polygon")


@query
def polygon_stats(spark, d):
    return tidy(_polygon_stats(spark, d))


@query
def zonal_stats(spark, d):
    return tidy(zonal.zone_means(_polygon_stats(spark, d), roles.polygons(spark, d), "polygon", ["zone"]))


# reports -----------------------------------------------------------------------------------------------------------


def _names(spark, d):
    return roles.census(spark, d).select("zone", "name", "state")


@query
def effect_lookup(spark, d):
    """Slopes of log counts on two terms, as a coefficient table, and the effect sizes they imply."""
    base = roles.event_weekly_panel(spark, d)
    fits = [(m, t) for m in ("admissions", "confirmed") for t in ("days_above", "reading")]
    slopes = base.agg(*[F.regr_slope(F.log1p(m), t).alias(f"{m}.{t}") for m, t in fits])
    table_ = slopes.unpivot([], [f"`{m}.{t}`" for m, t in fits], "_label", "estimate").select(
        F.split("_label", r"\.")[0].alias("model"), F.split("_label", r"\.")[1].alias("term"), "estimate")
    wide = effects.coefficients_wide(table_, ["days_above", "reading"])
    sized = effects.effect_sizes(table_).filter(F.col("term") == "days_above").select("model", "decrease", "increase")
    return tidy(wide.join(sized, "model"))


@query
def report_overall(spark, d):
    """Two rows: the states that send whole weeks only, and all chosen states, whose mean is unknown where a day is."""
    base = roles.monitored(roles.event_base_panel(spark, d, ()))
    rows = [reports.report_overall(base, roles.effects(), period="week", periods=roles.LAST_WEEK, states=states).withColumn("scope", F.lit(scope))
            for scope, states in (("whole", roles.STATES[::2]), ("all", roles.STATES))]
    return tidy(rows[0].unionByName(rows[1]))


@query
def report_states(spark, d):
    """Every state twice, from all its zones: over the season's weeks and over the last week, which is known more often."""
    base = checkpointed(roles.event_base_panel(spark, d, ()))
    rows = [reports.report_states(base, roles.effects(), period="week", periods=weeks).withColumn("scope", F.lit(scope))
            for scope, weeks in (("season", roles.SEASON), ("last week", roles.LAST_WEEK))]
    return tidy(rows[0].unionByName(rows[1]))


@query
def report_vulnerable(spark, d):
    base = checkpointed(roles.event_base_panel(spark, d, ()))
    return tidy(reports.report_vulnerable(base, roles.flagged_zones(base), _names(spark, d), roles.effects(), zone="zone",
                                          period="week", periods=roles.SEASON))


@query
def report_warned(spark, d):
    """Clusters to report: the zones of the most exposed cluster and the extra admissions of their last week."""
    base = checkpointed(roles.event_base_panel(spark, d, ()))
    return tidy(reports.report_vulnerable(base, roles.warned_zones(spark, base), _names(spark, d), roles.effects(), zone="zone",
                                          period="week", periods=roles.LAST_WEEK, text=False))


@query
def report_zones(spark, d):
    return tidy(reports.report_zones(roles.event_base_panel(spark, d, ()), _names(spark, d), roles.effects(), zone="zone",
                                     period="week", periods=roles.SEASON, states=roles.STATES, text=False))


@query
def semi_vulnerable(spark, d):
    base = checkpointed(roles.event_base_panel(spark, d, ()))
    rows = reports.only_zones(base, roles.flagged_zones(base), "zone")
    return rows.select("zone", "week", "admissions", "days_above", "name", "state")


def _season(spark, d):
    return reports.season_filter(roles.event_base_panel(spark, d, ()), "week", min(roles.SEASON), max(roles.SEASON))


_ZONE_KEYS = ["zone", "name", "state", "pop"]


@query
def report_season(spark, d):
    return tidy(reports.report_totals(_season(spark, d), roles.effects(), _ZONE_KEYS))


@query
def report_grouped_by_measure(spark, d):
    return tidy(reports.report_totals(_season(spark, d), roles.effects(), _ZONE_KEYS, measures_in_key=True))


@query
def report_single_state_month(spark, d):
    return tidy(reports.report_single_state_period(roles.event_base_panel(spark, d, ("fires",)), roles.effects(), _ZONE_KEYS, period="week",
                                                   value=2, state="NATION_4"))


@query
def counterfactual(spark, d):
    out = reports.counterfactual(roles.event_base_panel(spark, d, ()), roles.effects())
    return tidy(out, "zone", "name", "state", "pop", "size", "week", "admissions", "confirmed", "days_above",
                "ratio_admissions", "ratio_confirmed", "admissions_without", "confirmed_without")


@query
def source_reconciliation(spark, d):
    return reports.source_reconciliation(roles.event_base_panel(spark, d, ("counter",)), "week", ["deaths_confirmed", "deaths_new"])


@query
def log_histogram(spark, d):
    return tidy(reports.log_histogram(table(spark, d, "orders"), "o_totalprice"))


# models --------------------------------------------------------------------------------------------------------------


@query
def standardize(spark, d):
    return tidy(cluster.standardize(roles.order_profile(spark, d), list(roles.PROFILE)))


def _scaled(spark, d):
    return cluster.standardize(roles.order_profile(spark, d), list(roles.PROFILE))


@query
def kmeans_profile(spark, d):
    features_ = list(roles.PROFILE)
    scaled = _scaled(spark, d)
    centers, cost = cluster.kmeans(scaled, "zone", features_)
    sizes = cluster.assign_clusters(scaled, centers, features_).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    worst = cluster.vulnerable_cluster(centers, features_)
    out = sizes.join(cluster.centers_table(spark, centers, features_), "cluster", "left")
    return tidy(out.withColumns({"vulnerable": F.col("cluster") == worst, "cost": F.lit(cost)}))


@query
def vulnerable_zones(spark, d):
    return cluster.vulnerable_zones(roles.order_profile(spark, d), "zone", list(roles.PROFILE))


@query
def kmeans_variants(spark, d):
    """The clustering with all features, without the population, and on exposure alone."""
    every = list(roles.PROFILE)
    sets = {"all": every, "without population": [c for c in every if c != "pop"], "exposure": ["admissions", "reading", "days_above"]}
    return tidy(cluster.variants(roles.order_profile(spark, d), "zone", sets))


@query
def kmeans_elbow(spark, d):
    return cluster.elbow(_scaled(spark, d), "zone", list(roles.PROFILE))


@query
def kmeans_gap(spark, d):
    return cluster.gap_statistic(_scaled(spark, d), "zone", list(roles.PROFILE), max_k=10, references=50, restarts=25)


_TERMS = dict(numeric=["balance", "price"], factors=["segment"])


def _fit(spark, d, **kw):
    return countmodel.fit_counts(roles.count_rows(spark, d), "shipped", exposure="orders", level=["c_custkey", "year"], **_TERMS, **kw)


@query
def kmeans_one_pass(spark, d):
    """What three given centres make of the standardised profiles."""
    return tidy(cluster.summary(_scaled(spark, d), "zone", list(roles.PROFILE), np.array(roles.CENTERS)))


@query
def nb_mixed_levels(spark, d):
    """One intercept per customer, shared by the customer's years."""
    return tidy(countmodel.fit_counts(roles.count_rows(spark, d), "shipped", exposure="orders", level=["c_custkey"], mixed=True, **_TERMS).table, digits=4)


@query
def nb_many_levels(spark, d):
    """One fixed effect per customer beside the price: how the effects spread, and the shared coefficient."""
    fit = manylevels.fit_many_levels(roles.count_rows(spark, d), "shipped", "c_custkey", numeric=["price"], exposure="orders")
    kept = fit.levels.filter(F.col("effect") > float("-inf"))
    return tidy(kept.agg(F.count(F.lit(1)).alias("levels"), F.avg("effect").alias("mean_effect"), F.stddev_samp("effect").alias("spread")).withColumns(
        {"price": F.lit(fit.beta["price"]), "theta": F.lit(fit.theta), "log_lik": F.lit(fit.log_lik)}), digits=3)


@query
def nb_level_likelihood(spark, d):
    """Log-likelihood of a given model with one intercept per customer, by segment."""
    return _level_likelihood(spark, d, roles.GIVEN._replace(sigma=0.3))


@query
def nb_zero_inflated_likelihood(spark, d):
    """The same with a tenth of structural zeros, counting orders dear enough as no shipment."""
    return _level_likelihood(spark, d, roles.GIVEN._replace(sigma=0.3, inflation=0.1), zeros=True)


def _level_likelihood(spark, d, given, zeros=False):
    rows = roles.count_rows(spark, d)
    if zeros:
        rows = rows.withColumn("shipped", F.when(F.col("price") > 2.5, 0.0).otherwise(F.col("shipped")))
    ll = countmodel.level_likelihoods(rows, given, "shipped", "c_custkey", nodes=41, **_TERMS)
    by = ll.join(table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment")), "c_custkey").groupBy("segment")
    return tidy(by.agg(F.count(F.lit(1)).alias("customers"), F.sum("n").alias("rows"), F.sum("log_lik").alias("log_lik")), digits=2)


@query
def residual_check_given(spark, d):
    return tidy(countmodel.residual_check(roles.count_rows(spark, d), roles.GIVEN, "shipped", ["segment"], **_TERMS), digits=4)


@query
def residual_histogram(spark, d):
    return tidy(countmodel.residual_histogram(roles.count_rows(spark, d), roles.GIVEN, "shipped", ["segment"], **_TERMS), digits=5)


@query
def nb_regression(spark, d):
    return tidy(_fit(spark, d).table, digits=4)


@query
def nb_zero_inflated(spark, d):
    return tidy(_fit(spark, d, inflated=True).table, digits=4)


@query
def nb_mixed(spark, d):
    return tidy(_fit(spark, d, mixed=True).table, digits=4)


@query
def residual_check(spark, d):
    rows = roles.count_rows(spark, d)
    return tidy(countmodel.residual_check(rows, _fit(spark, d), "shipped", ["segment"], **_TERMS), digits=4)

from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazeline.operators import raster, zonal

RING = "polygon string, ring_id int, points array<struct<x: double, y: double>>"


def area(points):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1]))) / 2


def cover(spark, rings, **kw):
    edges = zonal.ring_edges(spark.createDataFrame(rings, RING), ["polygon"])
    return {(r["polygon"], r["cell_x"], r["cell_y"]): r["cov"] for r in zonal.coverage(edges, "polygon", **kw).collect()}


CONCAVE = [(0.3, -0.4), (4.7, 0.2), (3.1, 1.9), (5.2, 4.6), (1.1, 3.3)]
HOLE = [(1.6, 1.1), (2.6, 1.2), (2.4, 2.5), (1.7, 2.2)]


@pytest.mark.parametrize("outer_step, hole_step", [(1, 1), (1, -1), (-1, 1), (-1, -1)])
def test_area_with_hole_in_any_direction(spark, outer_step, hole_step):
    got = cover(spark, [("p", 0, CONCAVE[::outer_step]), ("p", 1, HOLE[::hole_step])])
    assert sum(got.values()) == pytest.approx(area(CONCAVE) - area(HOLE), abs=1e-9)
    assert all(0 < c <= 1 + 1e-9 for c in got.values())


def test_cells_against_random_points(spark):
    got = cover(spark, [("p", 0, CONCAVE)])
    rng = np.random.default_rng(1)
    pts = rng.uniform((-1, -1), (6, 6), (200_000, 2))
    inside = np.zeros(len(pts), bool)
    for (ax, ay), (bx, by) in zip(CONCAVE, CONCAVE[1:] + CONCAVE[:1]):
        crosses = (ay > pts[:, 1]) != (by > pts[:, 1])
        with np.errstate(divide="ignore", invalid="ignore"):
            inside ^= crosses & (pts[:, 0] < (bx - ax) * (pts[:, 1] - ay) / (by - ay) + ax)
    cells, n = np.unique(np.floor(pts[inside]).astype(int), axis=0, return_counts=True)
    for (x, y), k in zip(cells, n):
        assert got[("p", x, y)] == pytest.approx(k * 49 / 200_000, abs=0.03)


def test_axis_parallel_edges_single_cell_and_grid_step(spark):
    square = [(1.0, 1.0), (3.0, 1.0), (3.0, 2.0), (1.0, 2.0)]
    tiny = [(7.2, 7.2), (7.6, 7.2), (7.6, 7.7), (7.2, 7.7)]
    got = cover(spark, [("s", 0, square), ("t", 0, tiny)])
    assert got == {("s", 1, 1): pytest.approx(1.0), ("s", 2, 1): pytest.approx(1.0), ("t", 7, 7): pytest.approx(0.2)}
    half = cover(spark, [("s", 0, square)], x0=1.0, y0=1.0, dx=0.5, dy=0.5)
    assert len(half) == 8 and all(c == pytest.approx(1.0) for c in half.values())


def brute_median(pairs):
    pairs = sorted(pairs)
    total, so_far = sum(w for _, w in pairs), 0
    for v, w in pairs:
        so_far += w
        if 2 * so_far >= total:
            return v


@pytest.mark.parametrize("kw", [{}, {"pivots": 2, "rounds": 1}, {"pivots": 3, "rounds": 3}])
def test_weighted_summary_against_brute_force(spark, kw):
    rng = random.Random(7)
    rows = [(g, float(rng.choice([rng.randint(0, 9), rng.gauss(0, 1000)])), rng.choice([0.25, 0.5, 1.0]))
            for g in "abc" for _ in range(301)]
    rows += [("one", 5.0, 0.5), ("same", 1.0, 1.0), ("same", 1.0, 0.5), ("tie", 1.0, 1.0), ("tie", 2.0, 1.0), ("null", None, 1.0), ("zero", 1.0, 0.0), ("hole", 1.0, None)]
    rows += [("wild", 1e12, 1e-10), ("wild", -1e12, 1e-10), *[("wild", float(i), 1e-10) for i in range(99)], ("heavy", 1e12, 3e9), ("heavy", 0.5, 3e9), ("heavy", 0.25, 1e-10)]
    df = spark.createDataFrame(rows, "g string, v double, w double")
    got = {r["g"]: r for r in zonal.weighted_summary(df, ["g"], "v", "w", **kw).collect()}
    assert set(got) == {"a", "b", "c", "one", "same", "tie", "wild", "heavy"}
    assert got["wild"]["median"] == 49.0 and got["heavy"]["median"] == 0.5
    for g, r in got.items():
        pairs = [(v, Fraction(w)) for h, v, w in rows if h == g]
        assert r["median"] == brute_median(pairs) and r["max"] == max(v for v, _ in pairs)
        assert r["mean"] == pytest.approx(float(sum(Fraction(v) * w for v, w in pairs) / sum(w for _, w in pairs)))


def test_zonal_stats_and_zone_means(spark):
    grid = spark.sql("select cell_x, 0 cell_y, date'2020-01-01' date, value from values (0, 1.0D), (1, 3.0D), (2, null) t(cell_x, value)")
    cov = spark.createDataFrame([("p", 0, 0, 1.0), ("p", 1, 0, 0.5), ("p", 2, 0, 1.0), ("q", 1, 0, 0.1)],
                                "polygon string, cell_x int, cell_y int, cov double")
    got = {(r["polygon"], r["fun"]): r["value"] for r in zonal.zonal_stats(grid, cov, "polygon").collect()}
    assert got == {("p", "mean"): pytest.approx(5 / 3), ("p", "median"): 1.0, ("p", "max"): 3.0,
                   ("q", "mean"): pytest.approx(3.0), ("q", "median"): 3.0, ("q", "max"): 3.0}
    short = zonal.zonal_stats(grid, cov, "polygon", functions=["max"])
    assert sorted(r["value"] for r in short.collect()) == [3.0, 3.0]
    zones = spark.createDataFrame([("p", "z"), ("q", "z")], "polygon string, zone string")
    out = zonal.zone_means(zonal.zonal_stats(grid, cov, "polygon"), zones, "polygon", ["zone"])
    assert {r["fun"]: r["value"] for r in out.collect()} == {"mean": pytest.approx(7 / 3), "median": 2.0, "max": 3.0}


BANDS = """select timestamp_ntz'2020-01-02 00:00:00' band_ts, timestamp_ntz'2020-01-01 00:00:00' run_ts, 1 cell_x, 1 cell_y, 1e-9D value
 union all select timestamp_ntz'2020-01-02 00:00:00', timestamp_ntz'2020-01-02 00:00:00', 1, 1, 3e-9D
 union all select timestamp_ntz'2020-01-02 12:00:00', timestamp_ntz'2020-01-02 00:00:00', 1, 1, 9e-9D"""


def test_band_label_pairs_utc_day_with_local_clock(spark):
    labels = sorted(r["band"] for r in raster.consolidate(spark.sql(BANDS)).collect())
    assert labels == ["ymd_2020-01-02_07:00:00"] + ["ymd_2020-01-02_19:00:00"] * 2


@pytest.mark.parametrize("kw, want", [
    ({}, {"2020-01-02": 13 / 3}), ({"dedupe": "latest_run"}, {"2020-01-02": 6.0}),
    ({"day_basis": "local"}, {"2020-01-01": 2.0, "2020-01-02": 9.0}),
])
def test_daily_mean_choices(spark, kw, want):
    out = raster.daily_mean(raster.consolidate(spark.sql(BANDS)), **kw)
    assert {str(r["date"]): r["value"] for r in out.collect()} == pytest.approx(want)
    with pytest.raises(ValueError):
        raster.daily_mean(raster.consolidate(spark.sql(BANDS)), dedupe="first")


def test_selection_leaves_a_stated_share_of_a_group(spark):
    """One group holding nearly all rows gives the exact median, and at most two 64ths of it are ever put in order at once."""
    df = spark.range(20_001).select(F.when(F.col("id") < 20_000, "hot").otherwise("cold").alias("g"),
                                    (F.col("id") * 7919 % 20_011).cast("double").alias("v"), F.lit(1.0).alias("w"))
    got = {r["g"]: r["median"] for r in zonal.weighted_summary(df, ["g"], "v", "w").collect()}
    assert got["hot"] == sorted(i * 7919 % 20_011 for i in range(20_000))[9_999]
    atoms = df.select("g", F.col("v").alias("_v"), F.col("w").cast("decimal(38,18)").alias("_w"))
    whole = atoms.groupBy("g").agg(F.sum("_w").cast("decimal(38,18)").alias("_total"), F.lit(0.0).alias("mean"), F.max("_v").alias("max"))
    whole = whole.withColumns({"_above": F.lit(None).cast("double"), "_upto": F.col("max"), "_before": F.lit(0).cast("decimal(38,18)")})
    one = zonal._narrowed(atoms, whole, ["g"], 64)
    assert zonal._held(atoms, one, ["g"]).filter("g = 'hot'").count() <= 2 * 20_000 / 64
    two = zonal._narrowed(atoms, one, ["g"], 64)
    assert zonal._held(atoms, two, ["g"]).filter("g = 'hot'").count() <= 2 * 20_000 / 64**2 + 1


def test_walk_makes_no_more_rows_than_cells(spark):
    """Rows between the steps: crossed cells and one carry per edge and column; then covered cells.  No job before that."""
    rings = [("p", 0, CONCAVE), ("p", 1, HOLE), ("tall", 0, [(0.5, 0.5), (0.5, 900.5), (1.5, 900.5), (1.5, 0.5)])]
    edges = zonal.ring_edges(spark.createDataFrame(rings, RING), ["polygon"])
    crossed = carries = 0
    for (ax, ay), (bx, by) in ((a, b) for _, _, ps in rings for a, b in zip(ps, ps[1:] + ps[:1])):
        for x in range(math.floor(min(ax, bx)), math.ceil(max(ax, bx))) if ax != bx else ():
            ends = sorted(ay + (by - ay) / (bx - ax) * (min(max(c, min(ax, bx)), max(ax, bx)) - ax) for c in (x, x + 1))
            crossed += math.floor(ends[1]) - math.floor(ends[0]) + 1
            carries += 1
    steps = zonal.ring_columns(edges, "polygon", x0=0.0, y0=0.0, dx=1.0, dy=1.0)
    assert steps.count() <= crossed + carries < 100
    got = {(r["polygon"], r["cell_x"], r["cell_y"]): r["cov"] for r in zonal.coverage(edges, "polygon").collect()}
    assert sum(c for k, c in got.items() if k[0] == "tall") == pytest.approx(900) and sum(k[0] == "tall" for k in got) == 1802


def test_coverage_runs_no_job_when_called(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lazy", "coverage")
    zonal.coverage(zonal.ring_edges(spark.createDataFrame([("p", 0, CONCAVE)], RING), ["polygon"]), "polygon")
    assert not tracker.getJobIdsForGroup("lazy")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

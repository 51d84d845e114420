from __future__ import annotations

import math
import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from hazeline.functions import effects
from hazeline.operators import cluster, countmodel, manylevels, reports


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(3)
    centres = np.array([[0, 0, 0], [8, 0, 0], [0, 8, 1], [12, 8, -3]])
    x = np.vstack([c + rng.normal(0, 0.6, (60, 3)) for c in centres])
    return spark.createDataFrame([(f"z{i}", *map(float, r)) for i, r in enumerate(x)], "zone string, days_above double, reading double, pop double")


FEATURES = ["days_above", "reading", "pop"]


def test_standardize(spark, blobs):
    out = cluster.standardize(blobs.withColumn("flat", F.lit(1.0)), [*FEATURES, "flat"])
    row = out.agg(*[F.avg(c).alias(f"m{c}") for c in FEATURES], *[F.stddev_samp(c).alias(f"s{c}") for c in FEATURES], F.count("flat").alias("n")).first()
    for c in FEATURES:
        assert row[f"m{c}"] == pytest.approx(0, abs=1e-9) and row[f"s{c}"] == pytest.approx(1)
    assert row["n"] == 0


def test_kmeans_recovers_blobs_and_picks_the_worst(spark, blobs):
    centers, cost = cluster.kmeans(blobs, "zone", FEATURES, k=4, restarts=10)
    ml = min(KMeans(k=4, seed=s).fit(blobs.select(array_to_vector(F.array(*FEATURES)).alias("features"))).summary.trainingCost for s in (1, 2))
    assert cost <= ml * 1.0001
    labelled = cluster.assign_clusters(blobs, centers, FEATURES)
    assert sorted(r["count"] for r in labelled.groupBy("cluster").count().collect()) == [60] * 4
    direct = labelled.join(F.broadcast(cluster.centers_table(spark, centers, FEATURES).select("cluster", *[F.col(c).alias(f"c_{c}") for c in FEATURES])), "cluster")
    total = direct.agg(F.sum(sum((F.col(c) - F.col(f"c_{c}")) ** 2 for c in FEATURES))).first()[0]
    assert total == pytest.approx(cost)
    worst = cluster.vulnerable_cluster(centers, FEATURES)
    assert centers[worst - 1] == pytest.approx([12, 8, -3], abs=0.4)


def test_vulnerable_zones_are_those_of_the_worst_blob(blobs):
    got = {r["zone"] for r in cluster.vulnerable_zones(blobs, "zone", FEATURES, k=4, restarts=10).collect()}
    assert got == {f"z{i}" for i in range(180, 240)}


def test_rows_with_a_missing_feature_get_no_cluster(blobs):
    holes = blobs.withColumn("pop", F.when(F.col("zone") != "z0", F.col("pop")))
    centers, _ = cluster.kmeans(holes, "zone", FEATURES, k=4, restarts=5)
    out = cluster.assign_clusters(holes, centers, FEATURES)
    assert [r["zone"] for r in out.filter("cluster is null").collect()] == ["z0"]


def test_same_seed_same_fit_on_any_partitioning(blobs):
    a = cluster.kmeans(blobs, "zone", FEATURES, k=3, restarts=3)
    b = cluster.kmeans(blobs.repartition(7), "zone", FEATURES, k=3, restarts=3)
    assert a[1] == pytest.approx(b[1]) and np.allclose(a[0], b[0])


def test_elbow_falls_and_starts_at_the_total(blobs):
    cost = [r["cost"] for r in cluster.elbow(blobs, "zone", FEATURES, max_k=5, restarts=5).orderBy("k").collect()]
    total = blobs.agg(sum(F.var_pop(c) for c in FEATURES) * F.count(F.lit(1))).first()[0]
    assert cost[0] == pytest.approx(total) and all(a >= b - 1e-9 for a, b in zip(cost, cost[1:]))


def test_gap_peaks_at_the_true_number(blobs):
    rows = cluster.gap_statistic(blobs, "zone", FEATURES, max_k=5, references=4, restarts=4).orderBy("k").collect()
    assert max(rows, key=lambda r: r["gap"])["k"] == 4 and all(r["std_error"] > 0 for r in rows)


@pytest.mark.parametrize("rows", [10_000, 60])
def test_same_cost_as_plain_lloyd_from_the_same_starts(blobs, monkeypatch, rows):
    """Refined on the whole table or on a part of it, a fit ends where its centres are the means of their rows, and with
    the whole table in the sample the passes end at once."""
    monkeypatch.setattr(cluster, "SAMPLE_ROWS", rows)
    vectors = cluster._vectors(blobs, "zone", FEATURES, 41)
    x = np.array([r["x"] for r in vectors.collect()])
    stacks = cluster._starts(vectors, [5], 1, 6, 41)
    centers, cost = cluster.lloyd(vectors, stacks, max_iter=1 if rows > 240 else None)[(0, 5)]
    plain = []
    for c in stacks[(0, 5)][1]:
        while True:
            d = ((x[:, None] - c[None]) ** 2).sum(2)
            new = np.array([x[d.argmin(1) == j].mean(0) for j in range(5)])
            if np.abs(new - c).max() < 1e-9:
                break
            c = new
        plain.append(d.min(1).sum())
    assert cost == pytest.approx(min(plain)) and ((x[:, None] - centers[None]) ** 2).sum(2).min(1).sum() == pytest.approx(cost)


@pytest.mark.parametrize("between, passes", [((3000, 3000), 3), ((150, 150), None), ((0, 0), None)])
def test_fits_take_few_passes_and_end_where_plain_lloyd_does(spark, monkeypatch, between, passes):
    """Starts far from the end, as the sample is small: with all rows between centres one pass moves them to it."""
    monkeypatch.setattr(cluster, "SAMPLE_ROWS", 60)
    monkeypatch.setattr(cluster, "BETWEEN", between, raising=False)
    x = np.random.default_rng(7).uniform(0, 1, (3000, 2))
    df = spark.createDataFrame([(f"z{i}", *map(float, r)) for i, r in enumerate(x)], "zone string, a double, b double").repartition(3)
    vectors = cluster._vectors(df, "zone", ["a", "b"], 41)
    stacks = cluster._starts(vectors, [1, 4], 1, 3, 41)
    found = cluster.lloyd(vectors, stacks, max_iter=passes)
    for k in (1, 4):
        plain = []
        for c in stacks[(0, k)][1]:
            while True:
                d = ((x[:, None] - c[None]) ** 2).sum(2)
                new = np.array([x[d.argmin(1) == j].mean(0) for j in range(k)])
                if np.abs(new - c).max() < 1e-9:
                    break
                c = new
            plain.append(d.min(1).sum())
        centers, cost = found[(0, k)]
        assert cost == pytest.approx(min(plain), rel=1e-9) and ((x[:, None] - centers[None]) ** 2).sum(2).min(1).sum() == pytest.approx(cost, rel=1e-9)


def plain_lloyd(x, centers):
    while True:
        d = ((x[:, None] - centers[None]) ** 2).sum(2)
        own = d.argmin(1)
        new = np.array([x[own == j].mean(0) if (own == j).any() else c for j, c in enumerate(centers)])
        if np.abs(new - centers).max() <= 1e-9:
            return centers, d.min(1).sum()
        centers = new


@pytest.mark.parametrize("k", [1, 2, 6])
def test_rows_held_in_memory_end_where_plain_lloyd_does_with_few_distances(monkeypatch, k):
    rng = np.random.default_rng(3)
    x = np.repeat(rng.uniform(0, 1, (3000, 3)), 2, axis=0)
    starts = np.stack([x[rng.choice(len(x), k, replace=False)] for _ in range(4)])
    starts[0, -1] = 50.0  # loses all rows, unless it is the only one
    seen, steps = [], []
    distances, moved = cluster._distances, cluster._moved
    monkeypatch.setattr(cluster, "_distances", lambda wide, c: seen.append(len(wide) * len(c)) or distances(wide, c))
    monkeypatch.setattr(cluster, "_moved", lambda sums, old: steps.append(len(old)) or moved(sums, old))
    for together in (0, 8):
        found = cluster._settled(x, starts, 1e-9, together)
        for c, end in zip(starts, found):
            assert np.allclose(end, plain_lloyd(x, c)[0], atol=1e-9)
    assert k < 6 or sum(seen) < 0.6 * len(x) * sum(steps)


def test_a_table_of_a_few_samples_is_fitted_to_its_end_in_the_starts(spark, monkeypatch):
    """The pass over the table then only adds up costs: no second one, also for reference sets."""
    monkeypatch.setattr(cluster, "SAMPLE_ROWS", 200)
    x = np.random.default_rng(7).uniform(0, 1, (3000, 2))
    df = spark.createDataFrame([(f"z{i}", *map(float, r)) for i, r in enumerate(x)], "zone string, a double, b double").repartition(3)
    vectors = cluster._vectors(df, "zone", ["a", "b"], 41)
    box = cluster.Box(np.array([0.5, 0.5]), np.eye(2), np.array([-0.5, -0.5]), np.array([0.5, 0.5]))
    found = cluster.lloyd(vectors, cluster._starts(vectors, [1, 4], 2, 5, 41, box), box, max_iter=1)
    rows = vectors.toPandas()
    own, spot = np.stack(rows["x"]), rows["spot"].to_numpy()
    monkeypatch.setattr(cluster, "HELD", 1, raising=False)
    for (s, k), (_, begun) in cluster._starts(vectors, [1, 4], 2, 5, 41, box).items():
        points = cluster._points(own, spot, s, box)
        assert found[(s, k)][1] == pytest.approx(min(plain_lloyd(points, c)[1] for c in begun), rel=1e-9)


def test_rows_far_from_any_change_keep_their_centre():
    rng = np.random.default_rng(1)
    x, centers = rng.normal(0, 1, (2000, 3)), rng.normal(0, 1, (2, 4, 3))
    wide = cluster._wide(x)
    slot, best, after = cluster._nearest(wide, centers)
    margins = cluster._margins(wide, best, after)
    for f in range(2):
        step = rng.normal(0, 1, (4, 3))
        other = centers[f] + 0.2 * step / np.linalg.norm(step, axis=1)[:, None]
        kept = ((x[:, None] - other[None]) ** 2).sum(2).argmin(1) == slot[f]
        assert kept[margins[f] > 0.2].all() and not kept.all()
    below = np.cumsum(cluster._octave_counts(wide, centers), axis=1)[:, -3 - cluster.OCTAVES[0]]
    assert (below == (margins < 0.25).sum(1)).all()


def test_reference_points_do_not_depend_on_partitions_and_fill_the_box():
    spot = np.random.default_rng(0).integers(-(2**63), 2**63, 20_000)
    box = cluster.Box(np.array([1.0, 2.0]), np.array([[0.6, -0.8], [0.8, 0.6]]), np.array([-1.0, -3.0]), np.array([2.0, 4.0]))
    x = cluster._points(np.zeros((20_000, 2)), spot, 3, box)
    assert (cluster._points(np.zeros((5, 2)), spot[100:105], 3, box) == x[100:105]).all()
    along = (x - box.mean) @ box.axes
    assert (along >= box.low - 1e-9).all() and (along <= box.high + 1e-9).all()
    assert along.mean(0) == pytest.approx((box.low + box.high) / 2, abs=0.05) and abs(np.corrcoef(along.T)[0, 1]) < 0.03
    assert not np.allclose(cluster._points(np.zeros((20_000, 2)), spot, 4, box), x)


def test_summary_and_stored_centres(spark, blobs):
    centers = np.array([[0.0, 0, 0], [8, 0, 0], [0, 8, 1], [12, 8, -3]])
    got = {r["cluster"]: r for r in cluster.summary(blobs, "zone", FEATURES, centers).collect()}
    assert {c: r["n"] for c, r in got.items()} == dict.fromkeys((1, 2, 3, 4), 60)
    assert [got[4][c] for c in FEATURES] == pytest.approx([12, 8, -3], abs=0.4)
    assert (cluster.load_centers(cluster.centers_table(spark, centers, FEATURES), FEATURES) == centers).all()


def test_variants_show_who_is_named(spark, blobs):
    sets = {"all": FEATURES, "two": FEATURES[:2], "noise": ["pop", "reading", "days_above"]}
    got = {r["variant"]: r for r in cluster.variants(blobs, "zone", sets, k=4, restarts=8).collect()}
    assert got["all"]["vulnerable"] == got["all"]["shared"] == got["two"]["shared"] == got["noise"]["shared"] == 60
    assert {r["zones"] for r in got.values()} == {240} and got["two"]["features"] == "days_above, reading" and got["two"]["cost"] < got["all"]["cost"]


def test_too_few_rows(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "zone string, x double")
    with pytest.raises(ValueError):
        cluster.kmeans(df, "zone", ["x"], k=2, restarts=1)


# count models ---------------------------------------------------------------------------------------------------


def simulate(spark, n=4000, theta=3.0, sigma=0.0, inflation=0.0, seed=5):
    rng = np.random.default_rng(seed)
    x, pop = rng.normal(0, 1, n), rng.integers(50, 500, n)
    uf = rng.choice(["AC", "AM", "PA"], n)
    eta = np.log(pop) - 3.0 + 0.3 * x + np.select([uf == "AM", uf == "PA"], [0.4, -0.5], 0.0) + sigma * rng.normal(0, 1, n)
    y = rng.poisson(np.exp(eta) * rng.gamma(theta, 1 / theta, n)) * (rng.uniform(0, 1, n) >= inflation)
    rows = [(str(i), float(a), int(p), str(u), int(v)) for i, (a, p, u, v) in enumerate(zip(x, pop, uf, y))]
    return spark.createDataFrame(rows, "zone string, x double, pop bigint, uf string, y bigint")


def terms(fit):
    return {(r["component"], r["term"]): (r["estimate"], r["std_error"]) for r in fit.table.collect()}


ARGS = dict(numeric=["x"], factors=["uf"], exposure="pop")


def test_score_is_the_gradient():
    rng = np.random.default_rng(0)
    x = np.hstack([np.ones((30, 1)), rng.normal(0, 1, (30, 2))])
    y, off = rng.poisson(3, 30).astype(float) * (rng.uniform(0, 1, 30) > 0.3), rng.normal(0, 0.2, 30)
    z, w = np.polynomial.hermite.hermgauss(15)
    shape = countmodel._Shape(3, True, True, np.sqrt(2) * z, w / np.sqrt(np.pi))
    par = np.array([0.5, 0.2, -0.3, 0.7, -0.4, -1.0])
    _, score = countmodel.row_scores(par, y, off, x, shape)
    for j in range(6):
        up, down = par.copy(), par.copy()
        up[j] += 1e-5
        down[j] -= 1e-5
        diff = (countmodel.row_scores(up, y, off, x, shape)[0] - countmodel.row_scores(down, y, off, x, shape)[0]) / 2e-5
        assert score[:, j] == pytest.approx(diff, abs=1e-5)


def test_fixed_effects_recovered_within_three_errors(spark):
    fit = countmodel.fit_counts(simulate(spark), "y", **ARGS)
    got = terms(fit)
    for term, truth in (("(Intercept)", -3.0), ("x", 0.3), ("ufAM", 0.4), ("ufPA", -0.5)):
        est, err = got[("cond", term)]
        assert abs(est - truth) < 3 * err and err < 0.06
    assert fit.theta == pytest.approx(3.0, rel=0.2) and fit.sigma == 0 and fit.inflation == 0


def test_random_intercept_slopes_and_likelihood(spark):
    df = simulate(spark, n=3000, theta=8.0, sigma=0.6, seed=8)
    fixed, mixed = countmodel.fit_counts(df, "y", **ARGS), countmodel.fit_counts(df, "y", mixed=True, level=["zone"], **ARGS)
    est, err = terms(mixed)[("cond", "x")]
    assert abs(est - 0.3) < 3 * err and mixed.sigma > 0.2
    assert mixed.log_lik >= fixed.log_lik - 1e-3


def test_zero_inflation_recovered(spark):
    df = simulate(spark, inflation=0.25, seed=9)
    fit = countmodel.fit_counts(df, "y", inflated=True, **ARGS)
    assert fit.inflation == pytest.approx(0.25, abs=0.04)
    assert fit.log_lik > countmodel.fit_counts(df, "y", **ARGS).log_lik


def test_missing_rows_are_dropped(spark):
    df = simulate(spark, n=400)
    holes = df.unionByName(df.limit(20).withColumn("x", F.lit(None).cast("double")))
    assert countmodel.fit_counts(holes, "y", **ARGS).log_lik == pytest.approx(countmodel.fit_counts(df, "y", **ARGS).log_lik, abs=1e-3)


def test_factors_of_too_many_levels_are_refused(spark):
    df = spark.range(600).select(F.col("id").cast("string").alias("uf"), F.lit(1).alias("y"))
    with pytest.raises(ValueError, match="manylevels"):
        countmodel.fit_counts(df, "y", factors=["uf"])


def simulate_levels(spark, sizes, theta=4.0, sigma=0.7, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for g, n in enumerate(sizes):
        u, x = sigma * rng.normal(), rng.normal(0, 1, n)
        y = rng.poisson(np.exp(1.2 + 0.4 * x + u) * rng.gamma(theta, 1 / theta, n))
        rows += [(f"g{g}", float(a), int(v)) for a, v in zip(x, y)]
    return spark.createDataFrame(rows, "zone string, x double, y bigint")


def test_levels_with_several_rows_recovered(spark):
    sizes = np.random.default_rng(1).integers(1, 51, 120)
    fit = countmodel.fit_counts(simulate_levels(spark, sizes), "y", numeric=["x"], mixed=True, level=["zone"])
    got = terms(fit)
    for key, truth in ((("cond", "x"), 0.4), (("cond", "(Intercept)"), 1.2), (("random", "log_sigma"), np.log(0.7)), (("disp", "log_theta"), np.log(4.0))):
        est, err = got[key]
        assert abs(est - truth) < 3 * err and 0 < err < 0.2, key
    assert fit.converged


def test_hot_levels_give_the_same_fit(spark, monkeypatch):
    df = simulate_levels(spark, [400, 900, 3, 1, 12, 30, 7, 25, 40, 6])
    args = dict(numeric=["x"], mixed=True, level=["zone"])
    whole = countmodel.fit_counts(df, "y", **args)
    direct = {r["zone"]: (r["n"], r["log_lik"]) for r in countmodel.level_likelihoods(df, whole, "y", "zone", numeric=["x"]).collect()}
    monkeypatch.setattr(countmodel, "HOT_ROWS", 100)
    split = countmodel.fit_counts(df, "y", **args)
    assert split.log_lik == pytest.approx(whole.log_lik, abs=1e-4) and split.sigma == pytest.approx(whole.sigma, rel=1e-3)
    parts = {r["zone"]: (r["n"], r["log_lik"]) for r in countmodel.level_likelihoods(df, whole, "y", "zone", numeric=["x"]).collect()}
    assert set(parts) == set(direct) and all(parts[k] == (n, pytest.approx(ll, abs=1e-5)) for k, (n, ll) in direct.items())
    assert sum(ll for _, ll in direct.values()) == pytest.approx(whole.log_lik, abs=1e-4)


@pytest.mark.parametrize("inflated", [False, True])
def test_levels_of_one_row_equal_the_row_likelihood(inflated):
    rng = np.random.default_rng(4)
    y, off, x = rng.poisson(3, 50).astype(float) * (rng.uniform(0, 1, 50) > 0.2), rng.normal(0, 0.3, 50), np.hstack([np.ones((50, 1)), rng.normal(0, 1, (50, 1))])
    z, w = np.polynomial.hermite.hermgauss(41)
    shape = countmodel._Shape(2, True, inflated, np.sqrt(2) * z, w / np.sqrt(np.pi))
    par = np.array([0.9, 0.2, 1.1, -0.5, *([-1.0] if inflated else [])])
    a, b = countmodel.row_scores(par, y, off, x, shape), countmodel.level_scores(par, y, off, x, np.arange(50), shape)
    assert a[0] == pytest.approx(b[0], abs=1e-6) and a[1] == pytest.approx(b[1], abs=1e-5)


@pytest.mark.parametrize("inflated", [False, True])
def test_one_evaluation_gives_the_information_of_levels(inflated):
    """The second derivatives equal differences of the score around the same nodes, which took 2 m more evaluations."""
    rng = np.random.default_rng(9)
    starts = np.cumsum([0, 1, 40, 3])
    x, y = np.hstack([np.ones((94, 1)), rng.normal(0, 1, (94, 1))]), rng.poisson(5, 94).astype(float) * (rng.uniform(0, 1, 94) > 0.2)
    z, w = np.polynomial.hermite.hermgauss(21)
    shape = countmodel._Shape(2, True, inflated, np.sqrt(2) * z, w / np.sqrt(np.pi))
    par = np.array([1.4, 0.2, 1.1, -0.3, *([-1.5] if inflated else [])])
    ll, score, h = countmodel.level_curves(par, y, np.zeros(94), x, starts, shape)
    own, slopes = countmodel.level_scores(par, y, np.zeros(94), x, starts, shape)
    assert ll == pytest.approx(own.sum()) and score == pytest.approx(slopes.sum(0), abs=1e-9)
    centre, width = countmodel._level_modes(par, y, x @ par[:2], starts, shape)
    for j, e in enumerate(1e-4 * np.eye(len(par))):
        up, down = (countmodel.integrated(countmodel.node_sums(par + s * e, y, np.zeros(94), x, starts, centre, width, shape), centre, width, shape)[1].sum(0) for s in (1, -1))
        assert h[j] == pytest.approx((up - down) / 2e-4, rel=1e-5, abs=1e-4)
    assert countmodel.trigamma(np.array([0.3, 12.0])) == pytest.approx([(countmodel.digamma(v + 1e-5) - countmodel.digamma(v - 1e-5)) / 2e-5 for v in (0.3, 12.0)], rel=1e-5)


def test_level_score_is_the_gradient_and_the_integral_is_exact():
    rng = np.random.default_rng(6)
    sizes = [1, 40, 3, 200]
    n, starts = sum(sizes), np.cumsum([0, *sizes[:-1]])
    y, x = rng.poisson(5, n).astype(float) * (rng.uniform(0, 1, n) > 0.2), np.hstack([np.ones((n, 1)), rng.normal(0, 1, (n, 1))])
    z, w = np.polynomial.hermite.hermgauss(31)
    shape = countmodel._Shape(2, True, True, np.sqrt(2) * z, w / np.sqrt(np.pi))
    par = np.array([1.4, 0.2, 1.1, -0.3, -1.5])
    ll, score = countmodel.level_scores(par, y, np.zeros(n), x, starts, shape)
    for j in range(5):
        side = [countmodel.level_scores(par + s * 1e-5 * np.eye(5)[j], y, np.zeros(n), x, starts, shape)[0] for s in (1, -1)]
        assert score[:, j] == pytest.approx((side[0] - side[1]) / 2e-5, abs=2e-4)
    u = np.linspace(-9, 9, 36001)
    for g, first in enumerate(starts):
        own = slice(first, first + sizes[g])
        total = -u**2 / 2
        for yi, xi in zip(y[own], x[own]):
            mu, theta, pi = np.exp(xi @ par[:2] + np.exp(par[3]) * u), np.exp(par[2]), 1 / (1 + np.exp(-par[4]))
            log_f = math.lgamma(yi + theta) - math.lgamma(theta) - math.lgamma(yi + 1) + theta * np.log(theta / (theta + mu)) + yi * np.log(mu / (theta + mu))
            total = total + (np.log(pi + (1 - pi) * np.exp(log_f)) if yi == 0 else np.log1p(-pi) + log_f)
        dense = np.log(np.exp(total - total.max()).sum() * (u[1] - u[0]) / np.sqrt(2 * np.pi)) + total.max()
        assert ll[g] == pytest.approx(dense, abs=1e-6)


def test_residuals_of_the_true_model_are_calm(spark):
    df = simulate(spark, seed=11)
    fit = countmodel.fit_counts(df, "y", **ARGS)
    for r in countmodel.residual_check(df, fit, "y", ["uf"], numeric=["x"], factors=["uf"]).collect():
        assert abs(r["mean_residual"]) < 0.1 and 0.8 < r["dispersion"] < 1.25
        assert r["zeros_observed"] == pytest.approx(r["zeros_expected"], abs=5 * np.sqrt(r["zeros_expected"] + 1))


@pytest.mark.parametrize("y, theta, sigma", [(200, 50.0, 0.6), (500, 100.0, 1.0), (2000, 200.0, 1.0), (0, 1.0, 0.5)])
def test_random_intercept_equals_a_dense_integral(y, theta, sigma):
    z, w = np.polynomial.hermite.hermgauss(21)
    shape = countmodel._Shape(1, True, False, np.sqrt(2) * z, w / np.sqrt(np.pi))
    par, u = np.array([np.log(150.0), np.log(theta), np.log(sigma)]), np.linspace(-12, 12, 20001)
    ll, _ = countmodel.row_scores(par, np.array([float(y)]), np.zeros(1), np.ones((1, 1)), shape)
    mu = 150 * np.exp(sigma * u)
    dense = math.lgamma(y + theta) - math.lgamma(theta) - math.lgamma(y + 1) + theta * np.log(theta / (theta + mu)) + y * np.log(mu / (theta + mu))
    total = np.log((np.exp(dense - dense.max() - u**2 / 2) / np.sqrt(2 * np.pi)).sum() * (u[1] - u[0])) + dense.max()
    assert abs(ll[0] - total) < 1e-6


def test_huge_counts_and_gamma_functions():
    z, w = np.polynomial.hermite.hermgauss(21)
    shape = countmodel._Shape(1, True, False, np.sqrt(2) * z, w / np.sqrt(np.pi))
    ll, g = countmodel.row_scores(np.array([20.0, 1.0, 0.0]), np.array([1e9, 3.0]), np.zeros(2), np.ones((2, 1)), shape)
    assert np.isfinite(ll).all() and np.isfinite(g).all()
    for x in (0.1, 1.0, 7.9, 8.0, 123.4, 1e6):
        assert countmodel.log_gamma(x) == pytest.approx(math.lgamma(x), rel=1e-11, abs=1e-11)
        assert countmodel.digamma(x) == pytest.approx((math.lgamma(x * (1 + 1e-5)) - math.lgamma(x * (1 - 1e-5))) / (2e-5 * x), rel=1e-4, abs=1e-4)


def test_distribution_function_is_the_sum_of_probabilities():
    for theta, mu in ((0.4, 3.0), (6.0, 250.0), (80.0, 1.5), (2.0, 5000.0)):
        y = np.arange(0, 400)
        log_f = [math.lgamma(i + theta) - math.lgamma(theta) - math.lgamma(i + 1) + theta * math.log(theta / (theta + mu)) + i * math.log(mu / (theta + mu)) for i in y]
        got = countmodel.distribution(y.astype(float), np.full(400, np.log(mu)), theta, 0.0, 0.1)
        assert got == pytest.approx(0.1 + 0.9 * np.cumsum(np.exp(log_f)), abs=1e-10)
    assert countmodel.distribution(np.array([-1.0]), np.zeros(1), 1.0, 0.5, 0.2) == [0.0]
    x = np.linspace(0, 1, 11)
    assert countmodel.incomplete_beta(2.0, 1.0, x) == pytest.approx(x**2, abs=1e-10)


def test_histogram_of_the_true_model_is_flat(spark):
    df = simulate(spark, n=20_000, sigma=0.5, theta=3.0, seed=21)
    truth = countmodel.CountFit(None, {"(Intercept)": -3.0, "x": 0.3, "ufAM": 0.4, "ufPA": -0.5}, 3.0, 0.5, 0.0, 0.0, "pop")
    rows = countmodel.residual_histogram(df, truth, "y", ["uf"], numeric=["x"], factors=["uf"]).collect()
    assert len(rows) == 30 and sum(r["share"] for r in rows) == pytest.approx(3)
    assert all(abs(r["share"] - 0.1) < 5 * np.sqrt(0.09 / r["n"]) for r in rows)
    wrong = countmodel.residual_histogram(df, truth._replace(theta=30.0, sigma=0.0), "y", ["uf"], numeric=["x"], factors=["uf"]).collect()
    assert max(r["share"] for r in wrong) > 0.2


def test_stored_fits_give_the_same_report(spark, tmp_path):
    df = simulate(spark, n=600, inflation=0.2)
    fit = countmodel.fit_counts(df, "y", inflated=True, model="admissions", **ARGS)
    for version in (1, 2):
        countmodel.stored_fit(fit._replace(theta=fit.theta), version).write.mode("append").parquet(str(tmp_path / "fits"))
    kept = spark.read.parquet(str(tmp_path / "fits"))
    back = countmodel.loaded_fit(kept, "admissions")
    assert (back.beta, back.theta, back.inflation, back.log_lik, back.offset, back.steps, back.converged) == (
        fit.beta, pytest.approx(fit.theta), pytest.approx(fit.inflation), fit.log_lik, "pop", fit.steps, fit.converged)
    direct, again = (countmodel.residual_check(df, f, "y", ["uf"], numeric=["x"], factors=["uf"]).orderBy("uf").collect() for f in (fit, back))
    assert [r["n"] for r in direct] == [r["n"] for r in again] and [r["dispersion"] for r in direct] == pytest.approx([r["dispersion"] for r in again])
    panel = spark.createDataFrame([("AC", 1, 3), ("AM", 1, 5)], "state string, month int, days_above int")
    reports_ = [[tuple(r) for r in reports.report_states(panel, {"x": effects.coefficient(f.table, "admissions", "x")}, period="month", periods=[1], text=False).collect()] for f in (fit, back)]
    assert reports_[0] == reports_[1] and reports_[0][0][2] > 0
    with pytest.raises(ValueError):
        countmodel.loaded_fit(kept, "other")


def test_many_levels_equal_the_dummy_columns(spark):
    df = simulate(spark, n=3000)
    wide = countmodel.fit_counts(df, "y", **ARGS)
    own = manylevels.fit_many_levels(df, "y", "uf", numeric=["x"], exposure="pop")
    assert own.beta["x"] == pytest.approx(wide.beta["x"], abs=1e-4) and own.theta == pytest.approx(wide.theta, rel=1e-3)
    assert own.log_lik == pytest.approx(wide.log_lik, abs=1e-3)
    effects_ = {r["uf"]: r["effect"] for r in own.levels.collect()}
    base = wide.beta["(Intercept)"]
    assert effects_ == pytest.approx({"AC": base, "AM": base + wide.beta["ufAM"], "PA": base + wide.beta["ufPA"]}, abs=1e-3)
    assert own.std_error["x"] == pytest.approx(terms(wide)[("cond", "x")][1], rel=0.1)


def test_a_table_of_level_effects(spark):
    """Thousands of levels, one hot, some without counts and a null one; the effects come back as a table."""
    rng, levels_ = np.random.default_rng(12), 4000
    lev = np.concatenate([np.repeat(np.arange(levels_), 6), np.zeros(6000, int)])
    effect, x = rng.normal(1.0, 0.5, levels_), rng.normal(0, 1, len(lev))
    effect[7] = -50.0
    y = rng.poisson(np.exp(effect[lev] + 0.3 * x) * rng.gamma(5.0, 0.2, len(lev)))
    df = spark.createDataFrame([(None if l == 3 else int(l), float(a), int(v)) for l, a, v in zip(lev, x, y)], "zone int, x double, y bigint")
    fit = manylevels.fit_many_levels(df, "y", "zone", numeric=["x"])
    assert abs(fit.beta["x"] - 0.3) < 4 * fit.std_error["x"] < 0.05
    got = {r["zone"]: (r["n"], r["effect"]) for r in fit.levels.collect()}
    assert len(got) == levels_ and got[7] == (6, -math.inf) and got[None][0] == 6
    assert got[0][0] == 6006 and got[0][1] == pytest.approx(effect[0], abs=0.1)
    found = [(e, effect[z]) for z, (n, e) in got.items() if z not in (None, 0, 7) and e > -5]
    assert np.corrcoef(np.array(found).T)[0, 1] > 0.8

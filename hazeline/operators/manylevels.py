"""Negative-binomial regression with one fixed effect per level of a key that may have any number of levels.

A dummy column per level would make the design as wide as the key.  Here the effects stay a table, one row per level.  The
information matrix is an arrow: a small block for the shared terms, a diagonal for the levels, and one short vector per
level between them.  Eliminating the diagonal leaves a system the size of the shared terms for the driver, and each
level's own step follows from its row.  One step reads the rows once, joined to the table of effects.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.operators.countmodel import digamma, log_gamma
from hazeline.operators.loops import checkpointed, matrix, spread


class LevelFit(NamedTuple):
    """Shared coefficients with standard errors, dispersion, and the table of level effects (level, n, effect)."""

    beta: dict[str, float]
    std_error: dict[str, float]
    theta: float
    levels: DataFrame
    log_lik: float
    steps: int


def _terms(y: np.ndarray, off: np.ndarray, x: np.ndarray, beta: np.ndarray, log_theta: float, nudge: float) -> np.ndarray:
    """Per row: log-likelihood, score and weight by the linear predictor, slope by log theta here and a nudge further."""
    eta = off + x @ beta

    def by_theta(lt):
        theta = np.exp(lt)
        tail = np.logaddexp(lt, eta)
        return theta * (digamma(theta + y) - digamma(theta) + lt + 1.0 - tail - (y + theta) * np.exp(-tail))

    theta, tail = np.exp(log_theta), np.logaddexp(log_theta, eta)
    log_l = log_gamma(theta + y) - log_gamma(theta) - log_gamma(y + 1.0) + theta * log_theta + y * eta - (y + theta) * tail
    share = np.exp(eta - tail)
    return np.stack([log_l, theta * (y * np.exp(-tail) - share), theta * share, by_theta(log_theta), by_theta(log_theta + nudge)], axis=1)


def _sums(rows: DataFrame, effects: DataFrame, beta: np.ndarray, log_theta: float, nudge: float) -> DataFrame:
    """Per level: sums ``v0`` and so on of the row terms, of score and weight times each shared term, and of weight times
    each pair of them.  Rows are added up in the tasks before the exchange."""
    p = len(beta)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    width = 5 + 2 * p + len(pairs)
    names = ["lev", *[f"v{i}" for i in range(width)]]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b, "x") if p else np.zeros((b.num_rows, 0))
            t = _terms(b.column("y").to_numpy(), b.column("off").to_numpy() + b.column("effect").to_numpy(), x, beta, log_theta, nudge)
            more = [t[:, 1:2] * x, t[:, 2:3] * x, *[(t[:, 2] * x[:, i] * x[:, j])[:, None] for i, j in pairs]]
            lev = b.column("lev").dictionary_encode()
            sums = np.zeros((len(lev.dictionary), width))
            np.add.at(sums, lev.indices.to_numpy(), np.hstack([t, *more]))
            yield pa.RecordBatch.from_arrays([lev.dictionary, *[pa.array(c) for c in sums.T]], names)

    joined = rows.join(effects, "lev").select("lev", "y", "off", "x", "effect")
    schema = "lev string, " + ", ".join(f"{n} double" for n in names[1:])
    return joined.mapInArrow(partial, schema).groupBy("lev").agg(*[F.sum(n).alias(n) for n in names[1:]])


def fit_many_levels(
    df: DataFrame, response: str, level: str, *, numeric: Sequence[str] = (), exposure: str | None = None, tol: float = 1e-6,
    max_steps: int | None = None,
) -> LevelFit:
    """Fit ``response ~ offset(log(exposure)) + numeric + level``, every level with an effect of its own and no intercept.

    Rows with a missing input, or an exposure of 0 or below, are dropped.  A level without any count has no finite effect:
    it is listed with an effect of minus infinity and takes no part, as its likelihood is 1 there.  A null level is one of its own.
    """
    known = df.dropna(subset=[response, *numeric, *([exposure] if exposure else [])])
    if exposure:
        known = known.filter(F.col(exposure) > 0)
    scale = known.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{k}{i}") for i, c in enumerate(numeric) for k, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    if scale["n"] == 0:
        raise ValueError("no complete rows")
    centre, width = ([float(scale[f"{k}{i}"]) for i in range(len(numeric))] for k in "ms")
    x = [(F.col(c).cast("double") - m) / s for c, m, s in zip(numeric, centre, width)]
    off = F.log(F.col(exposure).cast("double")) if exposure else F.lit(0.0)
    rows = known.select(F.to_json(F.struct(level)).alias("lev"), F.col(response).cast("double").alias("y"), off.alias("off"),
                        F.array(*x).cast("array<double>").alias("x"))
    rows = checkpointed(spread(rows, "lev", "y"))
    sizes = rows.groupBy("lev").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"), F.sum(F.exp("off")).alias("e"))
    sizes = checkpointed(sizes.withColumn("effect", F.log(F.col("y") / F.col("e"))))
    levels = checkpointed(sizes.filter("y > 0").select("lev", "effect"))
    p, nudge = len(numeric), 1e-4
    beta, log_theta, at = np.zeros(p), 0.0, None
    upper = np.triu_indices(p)
    d, s = F.col("v2"), F.col("v1")
    b = [F.col(f"v{5 + p + i}") for i in range(p)]
    for steps in itertools.count(1):
        if max_steps is not None and steps > max_steps:
            raise RuntimeError(f"the fit still climbs after {max_steps} steps")
        sums = checkpointed(_sums(rows, levels, beta, log_theta, nudge))
        # The shared block and score once every level's own row is eliminated.
        left = [F.sum(F.col(f"v{5 + 2 * p + k}") - b[i] * b[j] / d).alias(f"h{k}") for k, (i, j) in enumerate(zip(*upper))]
        right = [F.sum(F.col(f"v{5 + i}") - b[i] * s / d).alias(f"g{i}") for i in range(p)]
        total = sums.agg(F.sum("v0").alias("ll"), F.sum("v3").alias("t"), F.sum("v4").alias("u"), F.max(F.abs(s) / F.sqrt(d)).alias("far"), *left, *right).first()
        if at is not None and total["ll"] < at[0] - 1e-9 * abs(at[0]):  # too far: half the way back
            beta, log_theta = (beta + at[1]) / 2, (log_theta + at[2]) / 2
            levels = checkpointed(levels.join(at[3].withColumnRenamed("effect", "old"), "lev").select("lev", ((F.col("effect") + F.col("old")) / 2).alias("effect")))
            continue
        h = np.zeros((p, p))
        h[upper] = [total[f"h{k}"] for k in range(len(upper[0]))]
        h = h + np.triu(h, 1).T
        step = np.linalg.solve(h, [total[f"g{i}"] for i in range(p)]) if p else np.zeros(0)
        bend = (total["u"] - total["t"]) / nudge
        turn = float(np.clip(-total["t"] / bend if bend < 0 else np.sign(total["t"]), -1, 1))
        if max(np.abs(step).max(initial=0.0), abs(turn)) < tol and total["far"] < 1e-3:
            break
        at = (total["ll"], beta, log_theta, levels)
        own = (s - sum((bi * float(v) for bi, v in zip(b, step)), F.lit(0.0))) / d
        own = F.greatest(F.lit(-2.0), F.least(F.lit(2.0), own))
        levels = checkpointed(levels.join(sums.select("lev", own.alias("own")), "lev").select("lev", (F.col("effect") + F.col("own")).alias("effect")))
        beta, log_theta = beta + step, log_theta + turn
    error = np.sqrt(np.diag(np.linalg.inv(h))) if p else np.zeros(0)
    back = sum(v / w * m for v, w, m in zip(beta, width, centre))
    kind = df.schema[level].dataType.simpleString()
    every = sizes.select("lev", "n").join(levels, "lev", "left").select(
        F.from_json("lev", f"`{level}` {kind}")[level].alias(level), "n", F.coalesce(F.col("effect") - float(back), F.lit(float("-inf"))).alias("effect"))
    return LevelFit({c: float(v / w) for c, v, w in zip(numeric, beta, width)}, {c: float(e / w) for c, e, w in zip(numeric, error, width)},
                    float(np.exp(log_theta)), every, float(total["ll"]), steps)

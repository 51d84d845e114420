"""Negative-binomial (NB2) regression with offset: fixed effects, one random intercept per level, zero inflation.

``pyspark.ml`` has no negative-binomial family.  The likelihood is a sum over levels of the random intercept (over rows
without one), so each step of the fit is one Spark job: tasks add up log-likelihood, score and score products,
Spark adds the tasks up, and the driver solves a system the size of the coefficient vector.

Rows of a level share its intercept, which is integrated over their joint likelihood.  Levels are kept together in a
partition, except those of more than ``HOT_ROWS`` rows: their rows stay where they are, and their sums at the quadrature
nodes are added up across tasks before they are turned into a likelihood.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeline.operators.loops import checkpointed, matrix, spread


MOST_LEVELS = 500  # of a factor, each of which is a column of the design
HOT_ROWS = 50_000  # a level with more rows is summed across tasks


class CountFit(NamedTuple):
    """Coefficient table plus the numbers needed to predict."""

    table: DataFrame
    beta: dict[str, float]
    theta: float
    sigma: float
    inflation: float
    log_lik: float
    offset: str | None
    steps: int = 0
    converged: bool = True


class _Shape(NamedTuple):
    p: int
    mixed: bool
    inflated: bool
    nodes: np.ndarray
    weights: np.ndarray


def log_gamma(x):
    """Log of the gamma function for x > 0: Stirling's series above 8, recurrence below."""
    x = np.asarray(x, float)
    low = np.where(x < 8, x, 8.0)
    product = np.where(x < 8, low * (low + 1) * (low + 2) * (low + 3) * (low + 4) * (low + 5) * (low + 6) * (low + 7), 1.0)
    z = np.where(x < 8, x + 8, x)
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + series - np.log(product)


def digamma(x):
    """Derivative of ``log_gamma``."""
    x = np.asarray(x, float)
    low = np.where(x < 8, x, 8.0)
    shift = np.where(x < 8, sum(1 / (low + i) for i in range(8)), 0.0)
    z = np.where(x < 8, x + 8, x)
    return np.log(z) - 1 / (2 * z) - 1 / (12 * z**2) + 1 / (120 * z**4) - 1 / (252 * z**6) + 1 / (240 * z**8) - shift


def trigamma(x):
    """Derivative of ``digamma``."""
    x = np.asarray(x, float)
    low = np.where(x < 8, x, 8.0)
    shift = np.where(x < 8, sum(1 / (low + i) ** 2 for i in range(8)), 0.0)
    z = np.where(x < 8, x + 8, x)
    return 1 / z + 1 / (2 * z**2) + 1 / (6 * z**3) - 1 / (30 * z**5) + 1 / (42 * z**7) - 1 / (30 * z**9) + shift


def _modes(y: np.ndarray, fixed: np.ndarray, theta: float, sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """Mode of every row's random intercept (in standard deviations) and the width of its likelihood there."""
    u = np.zeros(len(y))
    for _ in range(100):  # a mode not met exactly only places the nodes a little off
        tail = np.logaddexp(np.log(theta), fixed + sigma * u)
        share, inverse = np.exp(fixed + sigma * u - tail), np.exp(-tail)
        slope = sigma * theta * (y * inverse - share) - u
        curve = 1 + sigma**2 * theta * share * (y + theta) * inverse
        step = np.clip(slope / curve, -2, 2)
        u = u + step
        if np.abs(step).max(initial=0.0) < 1e-10:
            break
    return u, 1 / np.sqrt(curve) if len(y) else u


def row_scores(par: np.ndarray, y: np.ndarray, off: np.ndarray, x: np.ndarray, shape: _Shape) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood and score of every row.

    ``par`` = (beta, log theta[, log sigma][, logit inflation]).  The quadrature nodes of a random intercept are centred
    and scaled at each row's own mode, so large counts, whose likelihood is narrow, are integrated as well.
    """
    p = shape.p
    beta, theta = par[:p], np.exp(par[p])
    sigma = np.exp(par[p + 1]) if shape.mixed else 0.0
    log_rising = log_gamma(theta + y) - log_gamma(theta)
    rising = digamma(theta + y) - digamma(theta)
    log_fact = log_gamma(y + 1.0)

    fixed = off + x @ beta
    centre, spread_ = _modes(y, fixed, theta, sigma) if shape.mixed else (np.zeros(len(y)), np.ones(len(y)))
    level = centre[:, None] + spread_[:, None] * shape.nodes[None, :]
    eta = fixed[:, None] + sigma * level
    tail = np.logaddexp(np.log(theta), eta)
    inverse, odds = np.exp(-tail), np.exp(eta - tail)  # 1 / (theta + mu) and mu / (theta + mu)
    k = (log_rising - log_fact + theta * np.log(theta))[:, None] + y[:, None] * eta - (y[:, None] + theta) * tail
    k = k + np.log(shape.weights)[None, :] + np.log(spread_)[:, None] + (shape.nodes[None, :] ** 2 - level**2) / 2
    peak = k.max(1, keepdims=True)
    e = np.exp(k - peak)
    total = e.sum(1)
    log_l = peak[:, 0] + np.log(total)
    post = e / total[:, None]

    s = theta * (y[:, None] * inverse - odds)
    d_theta = theta * (rising + np.log(theta) + 1.0 - (post * (tail + (y[:, None] + theta) * inverse)).sum(1))
    cols = [x * (post * s).sum(1)[:, None], d_theta[:, None]]
    if shape.mixed:
        cols.append((post * s * sigma * level).sum(1)[:, None])
    score = np.hstack(cols)
    if not shape.inflated:
        return log_l, score
    pi = 1.0 / (1.0 + np.exp(-par[-1]))
    zero = y == 0
    like = np.exp(log_l)
    mix = np.where(zero, pi + (1 - pi) * like, 1.0)
    ll = np.where(zero, np.log(mix), np.log1p(-pi) + log_l)
    share = np.where(zero, (1 - pi) * like / mix, 1.0)
    d_pi = np.where(zero, pi * (1 - pi) * (1 - like) / mix, -pi)
    return ll, np.hstack([score * share[:, None], d_pi[:, None]])


def _tails(theta: float, eta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``log(theta + mu)``, ``1 / (theta + mu)`` and ``mu / (theta + mu)``; only far steps of a fit need them by logarithms."""
    if theta > 1e-200 and eta.max(initial=0.0) < 600:
        mu = np.exp(eta)
        whole = theta + mu
        inverse = 1 / whole
        return np.log(whole), inverse, mu * inverse
    tail = np.logaddexp(np.log(theta), eta)
    return tail, np.exp(-tail), np.exp(eta - tail)


def _row_terms(par: np.ndarray, y: np.ndarray, eta: np.ndarray, shape: _Shape, second: bool = False):
    """At every node: log-likelihood of each row and its derivatives by eta, log theta and logit inflation.

    With ``second`` also the second derivatives: by eta twice, eta and log theta, log theta twice, then by logit inflation
    and eta, log theta and itself.
    """
    theta = np.exp(par[shape.p])
    tail, inverse, odds = _tails(theta, eta)
    fixed = log_gamma(theta + y) - log_gamma(theta) - log_gamma(y + 1.0) + theta * np.log(theta)
    rising = digamma(theta + y) - digamma(theta) + np.log(theta) + 1.0
    y_ = y[:, None]
    rest = (y_ + theta) * inverse
    log_l = fixed[:, None] + y_ * eta - (y_ + theta) * tail
    by_eta = theta * (y_ * inverse - odds)
    by_theta = theta * (rising[:, None] - tail - rest)
    bends = None
    if second:
        turn = trigamma(theta + y) - trigamma(theta) + 1 / theta
        bends = [-theta * odds * rest, by_eta * odds, by_theta + theta**2 * (turn[:, None] + inverse * (rest - 2))]
    if not shape.inflated:
        return (log_l, by_eta, by_theta, None, *([*bends, None, None, None] if second else []))
    pi = 1.0 / (1.0 + np.exp(-par[-1]))
    zero = (y == 0)[:, None]
    mix = np.logaddexp(np.log(pi), np.log1p(-pi) + log_l)
    share = np.where(zero, np.exp(np.log1p(-pi) + log_l - mix), 1.0)
    by_pi = np.where(zero, (1 - pi) * (1 - share) - pi * share, -pi)
    first = np.where(zero, mix, np.log1p(-pi) + log_l), by_eta * share, by_theta * share, by_pi
    if not second:
        return first
    both = share * (1 - share)
    bends = [share * b + both * c for b, c in zip(bends, (by_eta**2, by_eta * by_theta, by_theta**2))]
    return *first, *bends, -both * by_eta, -both * by_theta, both - pi * (1 - pi)


def _slopes(par: np.ndarray, y: np.ndarray, eta: np.ndarray, shape: _Shape) -> tuple[np.ndarray, np.ndarray]:
    """Per row at one value of its intercept: slope of the log-likelihood by eta and minus its expected curvature."""
    theta = np.exp(par[shape.p])
    tail, inverse, odds = _tails(theta, eta)
    slope, curve = theta * (y * inverse - odds), theta * odds * (y + theta) * inverse
    if not shape.inflated:
        return slope, curve
    pi = 1.0 / (1.0 + np.exp(-par[-1]))
    own = np.log1p(-pi) + theta * (np.log(theta) - tail)  # of a count of zero that is not structural
    slope = np.where(y == 0, slope * np.exp(own - np.logaddexp(np.log(pi), own)), slope)
    return slope, np.where(y == 0, np.abs(slope) * theta * inverse, curve)


def _level_modes(par: np.ndarray, y: np.ndarray, fixed: np.ndarray, starts: np.ndarray, shape: _Shape) -> tuple[np.ndarray, np.ndarray]:
    """Mode of every level's intercept (in standard deviations) and the width of its likelihood there."""
    sigma, owner = np.exp(par[shape.p + 1]), np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(y))))
    u = np.zeros(len(starts))
    for _ in range(100):
        slope, curve = _slopes(par, y, fixed + sigma * u[owner], shape)
        bent = 1 + sigma**2 * np.add.reduceat(curve, starts)
        step = np.clip((sigma * np.add.reduceat(slope, starts) - u) / bent, -1, 1)
        u = u + step
        if np.abs(step).max(initial=0.0) < 1e-9:
            break
    return u, 1 / np.sqrt(bent)


def node_sums(par, y, off, x, starts, centre, width, shape: _Shape) -> np.ndarray:
    """Per level and node: log-likelihood of its rows and that sum's derivatives by all of ``par``, levels x nodes x (1 + m)."""
    owner, shift = _shifts(par, y, starts, centre, width, shape)
    return _added(_row_terms(par, y, (off + x @ par[: shape.p])[:, None] + shift[owner], shape), x, starts, shift, shape)


def _shifts(par, y, starts, centre, width, shape: _Shape) -> tuple[np.ndarray, np.ndarray]:
    """Number of every row's level, and what its intercept adds to eta at each node."""
    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(y))))
    return owner, np.exp(par[shape.p + 1]) * (centre[:, None] + width[:, None] * shape.nodes[None, :])


def _added(terms, x: np.ndarray, starts: np.ndarray, shift: np.ndarray, shape: _Shape) -> np.ndarray:
    """``node_sums`` from the first derivatives of the rows."""
    log_l, by_eta, by_theta, by_pi = terms
    add = lambda c: np.add.reduceat(c, starts, axis=0)
    cols = [add(log_l), *[add(by_eta * x[:, j : j + 1]) for j in range(shape.p)], add(by_theta), add(by_eta) * shift]
    cols += [add(by_pi)] if shape.inflated else []
    return np.stack(cols, axis=2)


def _posterior(sums: np.ndarray, centre: np.ndarray, width: np.ndarray, shape: _Shape) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood of every level from its ``node_sums``, and the share of each node in it: the quadrature proper."""
    level = centre[:, None] + width[:, None] * shape.nodes[None, :]
    k = sums[:, :, 0] + np.log(shape.weights)[None, :] + np.log(width)[:, None] + (shape.nodes[None, :] ** 2 - level**2) / 2
    peak = k.max(1, keepdims=True)
    e = np.exp(k - peak)
    total = e.sum(1)
    return peak[:, 0] + np.log(total), e / total[:, None]


def integrated(sums: np.ndarray, centre: np.ndarray, width: np.ndarray, shape: _Shape) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood and score of every level from its ``node_sums``."""
    log_l, post = _posterior(sums, centre, width, shape)
    return log_l, np.einsum("gk,gkm->gm", post, sums[:, :, 1:])


def _bent(seconds, first: np.ndarray, weight: np.ndarray, x: np.ndarray, shift: np.ndarray, shape: _Shape) -> np.ndarray:
    """Second derivatives by all of ``par``, summed over rows and nodes with ``weight``; ``first`` is the slope by eta."""
    p, m = shape.p, shape.p + 2 + shape.inflated
    ee, et, tt, ep, tp, pp = seconds
    over = lambda c, w: np.einsum("nk,nk->n", w, c)
    moved = weight * shift
    h = np.zeros((m, m))
    h[:p, :p] = x.T @ (x * over(ee, weight)[:, None])
    h[:p, p], h[:p, p + 1] = x.T @ over(et, weight), x.T @ over(ee, moved)
    h[p, p], h[p, p + 1] = np.vdot(weight, tt), np.vdot(moved, et)
    h[p + 1, p + 1] = np.vdot(moved, ee * shift + first)
    if shape.inflated:
        h[:p, -1], h[p, -1], h[p + 1, -1], h[-1, -1] = x.T @ over(ep, weight), np.vdot(weight, tp), np.vdot(moved, ep), np.vdot(weight, np.broadcast_to(pp, weight.shape))
    return np.triu(h) + np.triu(h, 1).T


def _spread_of(sums: np.ndarray, post: np.ndarray) -> np.ndarray:
    """What the scores at a level's nodes add to its second derivatives, summed over levels: their spread over the nodes."""
    each = (np.sqrt(post)[:, :, None] * sums[:, :, 1:]).reshape(-1, sums.shape[2] - 1)
    mean = np.einsum("gk,gkm->gm", post, sums[:, :, 1:])
    return each.T @ each - mean.T @ mean


def level_curves(par: np.ndarray, y: np.ndarray, off: np.ndarray, x: np.ndarray, starts: np.ndarray, shape: _Shape) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood, score and second derivatives, summed over levels, nodes standing at the levels' modes."""
    fixed = off + x @ par[: shape.p]
    centre, width = _level_modes(par, y, fixed, starts, shape)
    owner, shift = _shifts(par, y, starts, centre, width, shape)
    terms = _row_terms(par, y, fixed[:, None] + shift[owner], shape, second=True)
    sums = _added(terms[:4], x, starts, shift, shape)
    log_l, post = _posterior(sums, centre, width, shape)
    h = _bent(terms[4:], terms[1], post[owner], x, shift[owner], shape) + _spread_of(sums, post)
    return log_l.sum(), np.einsum("gk,gkm->m", post, sums[:, :, 1:]), h


def level_scores(par: np.ndarray, y: np.ndarray, off: np.ndarray, x: np.ndarray, starts: np.ndarray, shape: _Shape) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood and score of every level.  A level's rows follow one another, from ``starts`` on."""
    centre, width = _level_modes(par, y, off + x @ par[: shape.p], starts, shape)
    return integrated(node_sums(par, y, off, x, starts, centre, width, shape), centre, width, shape)


def whole_levels(batches: Iterator[pa.RecordBatch], most: int = 2000) -> Iterator[tuple[np.ndarray, ...]]:
    """``(y, off, x, starts, lev)`` of complete levels, some ``most`` rows at a time, from rows sorted by ``lev``."""
    held: list[tuple] = []

    def joined():
        y, off, x, lev = (np.concatenate([part[i] for part in held]) for i in range(4))
        held.clear()
        starts = np.flatnonzero(np.concatenate(([True], lev[1:] != lev[:-1])))
        return y, off, x, starts, lev[starts]

    for b in batches:
        if not b.num_rows:
            continue
        whole = (b.column("y").to_numpy(), b.column("off").to_numpy(), matrix(b, "x"), b.column("lev").to_numpy(zero_copy_only=False))
        for i in range(0, b.num_rows, most):
            piece = tuple(c[i : i + most] for c in whole)
            lev = piece[3]
            other = np.flatnonzero(lev != lev[-1])
            last = int(other[-1]) + 1 if len(other) else 0  # where the level that may go on begins
            if held and (last or held[-1][3][-1] != lev[0]):
                if held[-1][3][-1] == lev[0]:
                    held.append(tuple(c[:last] for c in piece))
                    yield joined()
                else:
                    yield joined()
                    if last:
                        held.append(tuple(c[:last] for c in piece))
                        yield joined()
            elif last:
                held.append(tuple(c[:last] for c in piece))
                yield joined()
            held.append(tuple(c[last:] for c in piece))
    if held:
        yield joined()


class _Levels(NamedTuple):
    """Rows of a model with several rows per level: ``cold`` ones sorted by level, ``hot`` ones with their level's number."""

    cold: DataFrame
    hot: DataFrame | None
    names: list[str]
    modes: np.ndarray


def _levels(rows: DataFrame) -> _Levels:
    """Deals ``(y, off, x, lev)``; the names of hot levels, at most one per ``HOT_ROWS`` rows, go to the driver."""
    sizes = rows.groupBy("lev").count().filter(F.col("count") > HOT_ROWS)
    names = sorted(r["lev"] for r in sizes.select("lev").collect())
    hot = None
    if names:
        numbers = rows.sparkSession.createDataFrame(list(enumerate(names)), "number int, lev string")
        hot = checkpointed(spread(rows.join(numbers, "lev").select("y", "off", "x", "number")))
        rows = rows.join(numbers, "lev", "left_anti")
    return _Levels(checkpointed(spread(rows, "lev").sortWithinPartitions("lev")), hot, names, np.zeros(len(names)))


def _by_number(batch: pa.RecordBatch):
    """The batch's rows ordered by hot level: ``(y, off, x, starts, numbers)``."""
    number = batch.column("number").to_numpy()
    order = np.argsort(number, kind="stable")
    number = number[order]
    starts = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
    return batch.column("y").to_numpy()[order], batch.column("off").to_numpy()[order], matrix(batch, "x")[order], starts, number[starts]


def _hot_sums(hot: DataFrame, count: int, width: int, terms) -> np.ndarray:
    """Sums over the rows of each hot level of ``terms(y, off, x, starts, numbers)``, levels x width, added up across tasks."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[int, np.ndarray] = {}
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                y, off, x, starts, numbers = _by_number(b.slice(i, 2000))
                for n, v in zip(numbers.tolist(), terms(y, off, x, starts, numbers).reshape(len(starts), -1)):
                    acc[n] = acc.get(n, 0) + v
        for n, v in acc.items():
            yield pa.RecordBatch.from_arrays([pa.array([n] * len(v), pa.int32()), pa.array(np.arange(len(v), dtype="int32")), pa.array(v)], ["number", "slot", "v"])

    out = np.zeros((count, width))
    for r in hot.mapInArrow(partial, "number int, slot int, v double").groupBy("number", "slot").agg(F.sum("v").alias("v")).toLocalIterator():
        out[r["number"], r["slot"]] = r["v"]
    return out


def _hot_modes(levels: _Levels, par: np.ndarray, shape: _Shape) -> np.ndarray:
    """Moves ``levels.modes`` to the hot levels' modes, from where the last call left them; returns the widths."""
    sigma, u = np.exp(par[shape.p + 1]), levels.modes

    def terms(y, off, x, starts, numbers):
        owner = np.repeat(numbers, np.diff(np.append(starts, len(y))))
        slope, curve = _slopes(par, y, off + x @ par[: shape.p] + sigma * u[owner], shape)
        return np.stack([np.add.reduceat(slope, starts), np.add.reduceat(curve, starts)], axis=1)

    while True:
        slope, curve = _hot_sums(levels.hot, len(u), 2, terms).T
        bent = 1 + sigma**2 * curve
        step = np.clip((sigma * slope - u) / bent, -1, 1)
        u += step
        if np.abs(step * np.sqrt(bent)).max() < 1e-3:  # a small part of the width: nodes need no better centre
            return 1 / np.sqrt(bent)


def _hot_nodes(levels: _Levels, par: np.ndarray, centre: np.ndarray, width: np.ndarray, shape: _Shape) -> np.ndarray:
    """``node_sums`` of the hot levels."""
    def terms(y, off, x, starts, numbers):
        return node_sums(par, y, off, x, starts, centre[numbers], width[numbers], shape).reshape(len(starts), -1)

    flat = _hot_sums(levels.hot, len(levels.names), len(shape.nodes) * (1 + len(par)), terms)
    return flat.reshape(len(flat), len(shape.nodes), -1)


def _hot_bends(levels: _Levels, par: np.ndarray, post: np.ndarray, centre: np.ndarray, width: np.ndarray, shape: _Shape) -> np.ndarray:
    """Second derivatives of the rows of hot levels, by the nodes' shares in their level."""
    def terms(y, off, x, starts, numbers):
        owner, shift = _shifts(par, y, starts, centre[numbers], width[numbers], shape)
        found = _row_terms(par, y, (off + x @ par[: shape.p])[:, None] + shift[owner], shape, second=True)
        out = np.zeros((len(starts), len(par) ** 2))
        out[0] = _bent(found[4:], found[1], post[numbers][owner], x, shift[owner], shape).ravel()  # the levels are summed anyway
        return out

    return _hot_sums(levels.hot, len(levels.names), len(par) ** 2, terms).sum(0).reshape(len(par), -1)


def _level_sums(levels: _Levels, par: np.ndarray, shape: _Shape) -> tuple[float, np.ndarray, np.ndarray]:
    """Summed log-likelihood, score and observed information.

    Products of level scores would say little about few levels, so the information comes from second derivatives: those of
    the rows, by the nodes' shares in their level, and the spread of a level's scores over its nodes.
    """
    m = len(par)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(1 + m + m * m)
        for y, off, x, starts, _ in whole_levels(batches):
            ll, g, h = level_curves(par, y, off, x, starts, shape)
            acc += np.concatenate([[ll], g, h.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(acc.size, dtype="int32")), pa.array(acc)], ["slot", "v"])

    v = np.zeros(1 + m + m * m)
    for r in levels.cold.mapInArrow(partial, "slot int, v double").groupBy("slot").agg(F.sum("v").alias("v")).collect():
        v[r["slot"]] = r["v"]
    h = v[1 + m :].reshape(m, m)
    if levels.hot is not None:
        width = _hot_modes(levels, par, shape)
        sums = _hot_nodes(levels, par, levels.modes, width, shape)
        ll, post = _posterior(sums, levels.modes, width, shape)
        v[: 1 + m] += np.concatenate([[ll.sum()], np.einsum("gk,gkm->m", post, sums[:, :, 1:])])
        h = h + _hot_bends(levels, par, post, levels.modes, width, shape) + _spread_of(sums, post)
    return float(v[0]), v[1 : 1 + m], -(h + h.T) / 2


def _sums(rows: DataFrame, par: np.ndarray, shape: _Shape) -> tuple[float, np.ndarray, np.ndarray]:
    """Summed log-likelihood, score and score products: one job, m + m^2 + 1 numbers back."""
    m = len(par)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(1 + m + m * m)
        for b in batches:
            if b.num_rows:
                ll, g = row_scores(par, b.column("y").to_numpy(), b.column("off").to_numpy(), matrix(b, "x"), shape)
                acc += np.concatenate([[ll.sum()], g.sum(0), (g.T @ g).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(acc), dtype="int32")), pa.array(acc)], ["slot", "v"])

    parts = rows.mapInArrow(partial, "slot int, v double").groupBy("slot").agg(F.sum("v").alias("v"))
    v = np.zeros(1 + m + m * m)
    for r in parts.collect():
        v[r["slot"]] = r["v"]
    return float(v[0]), v[1:1 + m], v[1 + m:].reshape(m, m)


def _upright(h: np.ndarray) -> np.ndarray:
    """The matrix with negative curvature turned round, so that a step still climbs."""
    values, vectors = np.linalg.eigh(h)
    return h if values[0] > 0 else (vectors * np.maximum(np.abs(values), 1e-8 * np.abs(values).max() + 1e-12)) @ vectors.T


def _climb(sums, par: np.ndarray, max_steps: int | None, tol: float):
    """Damped Newton on ``sums(par)``, log-likelihood, score and information: damping falls after a gain, rises after a loss.

    Ends where a step promises less than ``tol``; converged if that step was not shortened by damping.  A caller's
    own limit raises if it is met before.
    """
    ll, g, h = sums(par)
    damp = 1e-3
    for steps in itertools.count(1):
        if max_steps is not None and steps > max_steps:
            raise RuntimeError(f"the fit still climbs after {max_steps} steps")
        up = _upright(h)
        step = np.linalg.solve(up + damp * np.diag(np.diag(up) + 1e-9), g)
        step *= min(1.0, 3.0 / max(np.abs(step).max(), 1e-12))
        if float(g @ step) < tol:
            break
        trial = sums(par + step)
        if np.isfinite(trial[0]) and trial[0] > ll:
            par, (ll, g, h), damp = par + step, trial, max(damp / 5, 1e-9)
        else:
            damp *= 10
            if damp > 1e8:
                break
    return par, ll, h, steps, damp <= 1


def _design(df: DataFrame, numeric: Sequence[str], factors: Sequence[str]):
    """Columns of the design: name, Column, centre, scale.  Numeric terms are standardised for the fit only."""
    terms = [("(Intercept)", F.lit(1.0), 0.0, 1.0)]
    if numeric:
        moments = df.agg(*[f(c).alias(f"{n}{j}") for j, c in enumerate(numeric) for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
        for j, c in enumerate(numeric):
            centre, scale = float(moments[f"m{j}"]), float(moments[f"s{j}"] or 0.0)
            if scale == 0.0:
                raise ValueError(f"term {c} is constant")
            terms.append((c, (F.col(c).cast("double") - centre) / scale, centre, scale))
    for c in factors:
        levels = sorted(r[0] for r in df.select(F.col(c).cast("string")).distinct().limit(MOST_LEVELS + 1).collect())
        if len(levels) > MOST_LEVELS:
            raise ValueError(f"{c} has more than {MOST_LEVELS} levels: see manylevels.fit_many_levels")
        terms += [(f"{c}{v}", (F.col(c).cast("string") == v).cast("double"), 0.0, 1.0) for v in levels[1:]]
    return terms


def fit_counts(
    df: DataFrame, response: str, *, numeric: Sequence[str] = (), factors: Sequence[str] = (), exposure: str | None = None,
    mixed: bool = False, inflated: bool = False, level: Sequence[str] = (), model: str | None = None,
    nodes: int = 21, max_steps: int | None = None, tol: float = 1e-5,
) -> CountFit:
    """Fit ``response ~ offset(log(exposure)) + terms [+ (1 | level)]``, optionally with constant zero inflation.

    Rows with any missing input, or an exposure of 0 or below, are dropped.  Factors use their first level as
    the base.  ``level`` names the random-effect key; its rows share one intercept, nulls being a level of their own.
    Without it every row has an intercept of its own.
    """
    needed = [response, *numeric, *factors, *([exposure] if exposure else [])]
    known = df.dropna(subset=needed)
    if exposure:
        known = known.filter(F.col(exposure) > 0)
    # Checks, moments, levels and every step read these rows: written once, the panel behind them runs once.
    known = checkpointed(spread(known.select(*dict.fromkeys([*needed, *level])), *level))
    shared = mixed and level and not known.groupBy(*level).count().filter("count > 1").isEmpty()
    off = F.log(F.col(exposure).cast("double")) if exposure else F.lit(0.0)
    terms = _design(known, numeric, factors)
    rows = known.select(F.col(response).cast("double").alias("y"), off.alias("off"), F.array(*[c for _, c, _, _ in terms]).alias("x"),
                        *([F.to_json(F.struct(*level)).alias("lev")] if shared else []))
    p = len(terms)
    z, w = np.polynomial.hermite.hermgauss(nodes) if mixed else (np.zeros(1), np.array([np.sqrt(np.pi)]))
    shape = _Shape(p, mixed, inflated, np.sqrt(2.0) * z, w / np.sqrt(np.pi))
    rate = rows.agg(F.sum("y").alias("y"), F.sum(F.exp("off")).alias("e")).first()
    start = np.zeros(p + 1 + mixed + inflated)
    start[0] = np.log(max(rate["y"], 0.5) / rate["e"])
    if mixed:
        start[p + 1] = np.log(0.5)
    if inflated:
        start[-1] = -2.0
    if shared:
        levels = _levels(rows)
        par, ll, h, steps, converged = _climb(lambda q: _level_sums(levels, q, shape), start, max_steps, tol)
    else:
        par, ll, h, steps, converged = _climb(lambda q: _sums(rows, q, shape), start, max_steps, tol)
    cov = np.linalg.pinv(h)
    # Back from standardised terms: beta_j / s_j, and the centres move into the intercept.
    back = np.eye(len(par))
    for j, (_, _, centre, scale) in enumerate(terms[1:], 1):
        back[j, j] = 1.0 / scale
        back[0, j] = -centre / scale
    est, err = back @ par, np.sqrt(np.clip(np.diag(back @ cov @ back.T), 0, None))
    names = [("cond", t[0]) for t in terms] + [("disp", "log_theta")]
    names += [("random", "log_sigma")] if mixed else []
    names += [("zi", "(Intercept)")] if inflated else []
    label = model or response
    out = [(label, c, t, float(b), float(s), float(b / s) if s > 0 else None) for (c, t), b, s in zip(names, est, err)]
    out.append((label, "fit", "log_lik", ll, None, None))
    table = df.sparkSession.createDataFrame(
        out, "model string, component string, term string, estimate double, std_error double, z double")
    return CountFit(
        table, {t[0]: float(b) for t, b in zip(terms, est)}, float(np.exp(par[p])),
        float(np.exp(par[p + 1])) if mixed else 0.0,
        float(1 / (1 + np.exp(-par[-1]))) if inflated else 0.0, ll, exposure, steps, converged,
    )


def level_likelihoods(
    df: DataFrame, fit: CountFit, response: str, level: str, *, numeric: Sequence[str] = (), factors: Sequence[str] = (), nodes: int = 21,
) -> DataFrame:
    """Per level of the random intercept, under a given fit: ``level``, its rows ``n`` and its log-likelihood ``log_lik``.

    Rows with a missing input are left out; a null level is one of its own.
    """
    known = df.dropna(subset=[response, *numeric, *factors, *([fit.offset] if fit.offset else [])])
    eta = linear_predictor(fit, numeric, factors)
    rows = known.select(F.col(response).cast("double").alias("y"), eta.alias("off"), F.array(F.lit(0.0)).alias("x"), F.to_json(F.struct(level)).alias("lev"))
    z, w = np.polynomial.hermite.hermgauss(nodes)
    shape = _Shape(1, True, fit.inflation > 0, np.sqrt(2.0) * z, w / np.sqrt(np.pi))
    par = np.array([0.0, np.log(fit.theta), np.log(fit.sigma), *([np.log(fit.inflation / (1 - fit.inflation))] if fit.inflation else [])])
    levels = _levels(checkpointed(rows))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for y, off, x, starts, lev in whole_levels(batches):
            ll, _ = level_scores(par, y, off, x, starts, shape)
            sizes = np.diff(np.append(starts, len(y)))
            yield pa.RecordBatch.from_arrays([pa.array(lev, pa.string()), pa.array(sizes, pa.int64()), pa.array(ll)], ["lev", "n", "log_lik"])

    out = levels.cold.mapInArrow(each, "lev string, n bigint, log_lik double")
    if levels.hot is not None:
        width = _hot_modes(levels, par, shape)
        ll, _ = integrated(_hot_nodes(levels, par, levels.modes, width, shape), levels.modes, width, shape)
        sizes = {r["number"]: r["count"] for r in levels.hot.groupBy("number").count().collect()}
        rows = [(name, sizes[i], float(v)) for i, (name, v) in enumerate(zip(levels.names, ll))]
        out = out.unionByName(df.sparkSession.createDataFrame(rows, "lev string, n bigint, log_lik double"))
    kind = df.schema[level].dataType
    back = F.from_json("lev", f"`{level}` {kind.simpleString()}")[level]
    return out.select(back.alias(level), "n", "log_lik")


def linear_predictor(fit: CountFit, numeric: Sequence[str], factors: Sequence[str]) -> Column:
    """Offset plus terms, as a Column over the model's input table."""
    eta = F.lit(fit.beta["(Intercept)"])
    if fit.offset:
        eta = eta + F.log(F.col(fit.offset).cast("double"))
    for c in numeric:
        eta = eta + F.lit(fit.beta[c]) * F.col(c)
    for c in factors:
        for term, b in fit.beta.items():
            if term.startswith(c) and term not in numeric:
                eta = eta + F.when(F.col(c).cast("string") == term[len(c):], F.lit(b)).otherwise(F.lit(0.0))
    return eta


def residual_check(
    df: DataFrame, fit: CountFit, response: str, by: Sequence[str], *,
    numeric: Sequence[str] = (), factors: Sequence[str] = (), nodes: int = 21,
) -> DataFrame:
    """Per group: rows, mean Pearson residual, dispersion (mean squared residual), observed and expected zeros."""
    needed = [response, *numeric, *factors, *([fit.offset] if fit.offset else [])]
    known = df.dropna(subset=needed)
    if fit.offset:
        known = known.filter(F.col(fit.offset) > 0)
    mean = F.exp(F.col("_eta") + fit.sigma**2 / 2)
    spread = (1 + 1 / fit.theta) * float(np.exp(fit.sigma**2))
    keep = 1 - fit.inflation
    m = keep * mean
    var = keep * (mean + mean * mean * spread) - m * m
    z, w = np.polynomial.hermite.hermgauss(nodes) if fit.sigma else (np.zeros(1), np.array([np.sqrt(np.pi)]))
    p0 = F.lit(0.0)
    for zq, wq in zip(z, w):
        mu = F.exp(F.col("_eta") + float(np.sqrt(2.0) * fit.sigma * zq))
        p0 = p0 + F.pow(F.lit(fit.theta) / (F.lit(fit.theta) + mu), F.lit(fit.theta)) * float(wq / np.sqrt(np.pi))
    rows = known.withColumn("_eta", linear_predictor(fit, numeric, factors)).withColumns({
        "_r": (F.col(response) - m) / F.sqrt(var), "_p0": fit.inflation + keep * p0,
    })
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("_r").alias("mean_residual"),
        F.avg(F.col("_r") * F.col("_r")).alias("dispersion"),
        F.sum((F.col(response) == 0).cast("bigint")).alias("zeros_observed"),
        F.sum("_p0").alias("zeros_expected"),
    )


def incomplete_beta(a, b, x):
    """Regularised incomplete beta function by its continued fraction, for arrays of a, b > 0 and 0 <= x <= 1."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    turn = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1 - x, x)
    inside = np.clip(z, 1e-300, 1.0)
    front = np.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * np.log(inside) + q * np.log1p(-np.minimum(z, 1 - 1e-16))) / p
    tiny = 1e-300
    c, d = np.ones_like(z), 1 / np.where(np.abs(1 - (p + q) * z / (p + 1)) < tiny, tiny, 1 - (p + q) * z / (p + 1))
    out = d.copy()
    for m in itertools.count(1):
        change = 1.0
        for top in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + top / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            out = out * d * c
            change = np.abs(d * c - 1).max(initial=0.0)
        if change < 1e-13:
            break
    value = np.where(z <= 0, 0.0, front * out)
    return np.where(turn, 1 - value, value)


def distribution(y: np.ndarray, eta: np.ndarray, fit_theta: float, sigma: float, inflation: float, nodes: int = 21) -> np.ndarray:
    """P(Y <= y) of every row; 0 below 0."""
    z, w = np.polynomial.hermite.hermgauss(nodes) if sigma else (np.zeros(1), np.array([np.sqrt(np.pi)]))
    mu = np.exp(eta[:, None] + np.sqrt(2.0) * sigma * z[None, :])
    below = incomplete_beta(fit_theta, np.maximum(y, 0)[:, None] + 1.0, fit_theta / (fit_theta + mu)) @ (w / np.sqrt(np.pi))
    return np.where(y < 0, 0.0, inflation + (1 - inflation) * below)


def residual_histogram(
    df: DataFrame, fit: CountFit, response: str, by: Sequence[str], *,
    numeric: Sequence[str] = (), factors: Sequence[str] = (), bins: int = 10, nodes: int = 21,
) -> DataFrame:
    """Probability-integral histogram per group: (by, bin, n, share).  A model that fits gives every bin 1 / ``bins``.

    A count's place in its distribution is the stretch from P(Y < y) to P(Y <= y), spread evenly over the bins it meets, so
    nothing is simulated.  Rows with a missing input are left out; a group's rows are added up in the tasks first.
    """
    known = df.dropna(subset=[response, *numeric, *factors, *([fit.offset] if fit.offset else [])])
    if fit.offset:
        known = known.filter(F.col(fit.offset) > 0)
    rows = known.select(F.to_json(F.struct(*by)).alias("g"), F.col(response).cast("double").alias("y"), linear_predictor(fit, numeric, factors).alias("eta"))
    theta, sigma, inflation = fit.theta, fit.sigma, fit.inflation

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.arange(bins + 1) / bins
        for b in batches:
            if not b.num_rows:
                continue
            y, eta = b.column("y").to_numpy(), b.column("eta").to_numpy()
            high, low = (distribution(v, eta, theta, sigma, inflation, nodes) for v in (y, y - 1))
            met = np.clip(edges[None, :], low[:, None], high[:, None])
            mass = np.diff(met, axis=1) / np.maximum(high - low, 1e-300)[:, None]
            groups = b.column("g").dictionary_encode()
            sums = np.zeros((len(groups.dictionary), bins))
            np.add.at(sums, groups.indices.to_numpy(), mass)
            count = np.bincount(groups.indices.to_numpy(), minlength=len(sums))
            names = np.repeat(groups.dictionary.to_numpy(zero_copy_only=False), bins)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.tile(np.arange(1, bins + 1, dtype="int32"), len(sums))),
                                              pa.array(np.repeat(count, bins), pa.int64()), pa.array(sums.ravel())], ["g", "bin", "n", "mass"])

    parts = rows.mapInArrow(partial, "g string, bin int, n bigint, mass double").groupBy("g", "bin").agg(F.sum("n").alias("n"), F.sum("mass").alias("mass"))
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    return parts.withColumn("g", F.from_json("g", kinds)).select(*[F.col("g")[c].alias(c) for c in by], "bin", "n", (F.col("mass") / F.col("n")).alias("share"))


def stored_fit(fit: CountFit, version: int) -> DataFrame:
    """The fit as rows to keep: its coefficient table, what a prediction needs besides, and a version."""
    spark, label = fit.table.sparkSession, fit.table.first()["model"]
    more = [(label, "meta", f"offset:{fit.offset}" if fit.offset else "no offset", None, None, None),
            (label, "meta", "steps", float(fit.steps), None, None), (label, "meta", "converged", float(fit.converged), None, None)]
    return fit.table.unionByName(spark.createDataFrame(more, fit.table.schema)).select(F.lit(version).alias("version"), "*")


def loaded_fit(rows: DataFrame, model: str, version: int | None = None) -> CountFit:
    """A fit back from ``stored_fit`` rows of any number of models and versions; the newest version if none is named."""
    own = rows.filter(F.col("model") == model)
    newest = own.agg(F.max("version")).first()[0] if version is None else version
    own = own.filter(F.col("version") == newest).drop("version")
    found = {(r["component"], r["term"]): r["estimate"] for r in own.collect()}
    if ("fit", "log_lik") not in found:
        raise ValueError(f"no fit of {model}, version {newest}")
    offset = next((t.removeprefix("offset:") for c, t in found if c == "meta" and t.startswith("offset:")), None)
    logit = found.get(("zi", "(Intercept)"))
    return CountFit(
        own.filter(F.col("component") != "meta"), {t: b for (c, t), b in found.items() if c == "cond"},
        float(np.exp(found[("disp", "log_theta")])), float(np.exp(found[("random", "log_sigma")])) if ("random", "log_sigma") in found else 0.0,
        0.0 if logit is None else float(1 / (1 + np.exp(-logit))), found[("fit", "log_lik")], offset,
        int(found[("meta", "steps")]), bool(found[("meta", "converged")]))

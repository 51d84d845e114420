"""Document quality by co-training.

Two logistic classifiers see two views of a document: its content (hashed byte trigrams and character shares) and its
metadata (source, language, length and layout).  Both start from the labelled rows.  In every round each one labels the
unlabelled rows it is surest of, in both classes, and hands them to the other.  Both are then calibrated on held-back
labels and their calibrated log odds combined.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.llm.common import pieces, labelled_sample, schema_with, sent, texts, thinned, with_columns

GRAMS, HASHED_META = 1024, 64


def content_view(text: str) -> np.ndarray:
    """Hashed byte trigrams (log counts, unit length) and shares of kinds of characters."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    out = np.zeros(GRAMS + 8, np.float32)
    if len(raw) >= 3:
        code = raw[:-2].astype(np.uint32) << 16 | raw[1:-1].astype(np.uint32) << 8 | raw[2:]
        counts = np.log1p(np.bincount((code * np.uint32(2654435761)) >> np.uint32(22), minlength=GRAMS))
        out[:GRAMS] = counts / np.linalg.norm(counts)
    if len(raw):
        table = np.bincount(raw, minlength=256) / len(raw)
        lower, upper, digit = table[97:123].sum(), table[65:91].sum(), table[48:58].sum()
        words = text.split()
        out[GRAMS:] = (lower, upper, digit, table[32], table[128:].sum(), table[33:48].sum() + table[58:65].sum(),
                       table[91:97].sum() + table[123:127].sum(), len(set(words)) / max(1, len(words)))
    return out


def meta_view(text: str, lang: str | None, source: str | None) -> np.ndarray:
    """Hashed source and language, length and layout."""
    out = np.zeros(HASHED_META + 8, np.float32)
    for name in (f"lang:{lang}", f"source:{source}"):
        out[zlib.crc32(name.encode()) % HASHED_META] += 1
    lines, n = text.split("\n"), len(text)
    out[HASHED_META:] = (
        math.log1p(n) / 10, math.log1p(len(lines)) / 5, math.log1p(n / len(lines)) / 8, len(set(lines)) / len(lines),
        n == 0, n < 100, sum(len(x) < 20 for x in lines) / len(lines), max(map(len, lines)) / max(1, n))
    return out


class Logistic:
    """Logistic regression on standardised features with class weights, by Adam on all rows."""

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 150, penalty: float = 1e-3) -> Logistic:
        self.mean, self.scale = x.mean(0), x.std(0) + 0.05 * float(x.std()) + 1e-6
        z = (x - self.mean) / self.scale
        w, b = np.zeros(x.shape[1], np.float32), 0.0
        first, second = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
        weight = weight / weight.sum()
        for t in range(1, steps + 1):
            d = (weight * (1 / (1 + np.exp(-np.clip(z @ w + b, -30, 30))) - y)).astype(np.float32)
            g = np.append(z.T @ d + penalty * w, d.sum())
            first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g**2
            move = 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
            w, b = (w - move[:-1]).astype(np.float32), b - move[-1]
        self.w, self.b = w, b
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.w + self.b, -30, 30)


def balanced(y: np.ndarray) -> np.ndarray:
    return np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))


def platt(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn margins into log odds, by Newton with a small penalty towards (1, 0)."""
    a, b = 1.0, 0.0
    x = np.stack([m, np.ones_like(m)], 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = x.T @ (p - y) + np.array([a - 1, b])
        h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
    return max(float(a), 0.05), float(b)


class CoTrained:
    """Both views' classifiers with their calibrations and the weight of the content view."""

    def fit(self, views: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray], rounds: int = 4, share: float = 0.05) -> CoTrained:
        """``views``: features of labelled rows by view; ``pool``: those of unlabelled rows, whose confident rows are
        exchanged, a ``share`` of the pool per class and round at most and only beyond 95 % certainty."""
        held = np.arange(len(y)) % 4 == 3
        given: list[dict[int, int]] = [{}, {}]
        for _ in range(rounds + 1):
            self.models = []
            for v in (0, 1):
                rows, marks = np.array(list(given[v]), np.int64), np.array(list(given[v].values()), np.float64)
                x = np.concatenate([views[v][~held], pool[v][rows]])
                labels = np.concatenate([y[~held], marks])
                weight = np.concatenate([balanced(y[~held]), 0.3 * balanced(marks)])
                self.models.append(Logistic().fit(x, labels, weight))
            for v in (0, 1):
                m = self.models[v].margin(pool[v]) if len(pool[v]) else np.zeros(0)
                most = int(share * len(m)) + 1
                order = np.argsort(m, kind="stable")
                for label, own in ((0, order[:most]), (1, order[::-1][:most])):
                    sure = own[np.where(label, m[own], -m[own]) > math.log(19)]
                    for i in sure.tolist():
                        given[1 - v].setdefault(i, label)
        margins = [m.margin(x[held]) for m, x in zip(self.models, views)]
        self.calibration = [platt(m, y[held]) for m in margins]
        odds = [a * m + b for (a, b), m in zip(self.calibration, margins)]
        tries = np.linspace(0.2, 1.2, 11)
        grid = [(u, v) for u in tries for v in np.linspace(0, 1, 11)]
        self.mixture = min(grid, key=lambda t: np.logaddexp(0, np.where(y[held] == 1, -1, 1) * (t[0] * odds[0] + t[1] * odds[1])).sum())
        return self

    def score(self, views: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Combined probability, and that of each view."""
        odds = [a * m.margin(x) + b for (a, b), m, x in zip(self.calibration, self.models, views)]
        both = self.mixture[0] * odds[0] + self.mixture[1] * odds[1]
        return tuple(1 / (1 + np.exp(-np.clip(o, -40, 40))) for o in (both, *odds))


def features(batch: pa.RecordBatch, text: str, lang: str, source: str) -> list[np.ndarray]:
    rows = texts(batch.column(text))
    meta = zip(rows, batch.column(lang).to_pylist(), batch.column(source).to_pylist())
    return [np.stack([content_view(t) for t in rows]), np.stack([meta_view(*m) for m in meta])]


def collected(df: DataFrame, text: str, lang: str, source: str, label: str | None) -> tuple[list[np.ndarray], np.ndarray]:
    """Both views of a bounded sample, made on the executors, in an order of their own."""
    def work(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = features(batch, text, lang, source)
                y = batch.column("_y")
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in np.hstack([a, b])], pa.binary()), y], ["x", "y"])

    picked = df.select(text, lang, source, (F.col(label) if label else F.lit(0)).cast("int").alias("_y"))
    rows = sorted((r.x, r.y) for r in picked.mapInArrow(work, "x binary, y int").collect())
    rows.sort(key=lambda r: zlib.crc32(r[0]))
    flat = np.frombuffer(b"".join(bytes(r[0]) for r in rows), np.float32).reshape(len(rows), GRAMS + HASHED_META + 16)
    return [flat[:, : GRAMS + 8], flat[:, GRAMS + 8 :]], np.array([r[1] for r in rows], np.float64)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
          label: str = "quality", most: int = 4000, unlabelled: int = 3000) -> CoTrained | None:
    """Fitted on the driver on at most ``most`` labelled rows (half of each label) and ``unlabelled`` others, by hash
    order.  None if either label is missing: nothing can then be rejected."""
    docs = docs.select(key, text, lang, source)
    views, y = collected(labelled_sample(docs, labels, key, label, most), text, lang, source, label)
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return None
    order = F.xxhash64(F.lit("pool"), F.col(key))
    others = thinned(docs, order, unlabelled, docs.count()).orderBy(order, key).limit(unlabelled)
    pool, _ = collected(others, text, lang, source, None)
    return CoTrained().fit(views, y, pool)


def scored(df: DataFrame, model: CoTrained | None, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Adds ``score`` (probability of good quality), ``score_content`` and ``score_meta``.  Null texts count as empty, null
    languages and sources as values of their own; without a model all scores are 1.  Repeated rows stay."""
    held = sent(df.sparkSession, model)
    names = ("score", "score_content", "score_meta")

    def work(batches):
        own = held()
        for batch in batches:
            for part in pieces(batch, text):
                out = own.score(features(part, text, lang, source)) if own else [np.ones(part.num_rows)] * 3
                yield with_columns(part, {n: pa.array(np.asarray(s, np.float64)) for n, s in zip(names, out)})

    return df.mapInArrow(work, schema_with(df, ", ".join(f"{n} double" for n in names)))

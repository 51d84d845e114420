"""Toxicity of whole texts by a small convolutional classifier, trained in numpy.

A word's embedding is the sum of three rows of a hashed table: those of the word and of its first four and six letters.  Filters of several widths run over the whole sequence, max pooling
takes each filter's best place, and a logistic layer gives the score.  As a filter is linear, its response is a sum of
per-word table entries, so long texts cost one gather per word and width.  The threshold is calibrated for each
language, told from the text's own function words, and the score is shifted so that 0.5 is that threshold.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.llm.common import labelled_sample, schema_with, sent, texts, with_columns

# Frequent function words of four languages; texts without any count as a language of their own.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was on are with as".split(),
    "de": "der die und den von zu das mit sich des auf für ist dem nicht ein eine als auch".split(),
    "fr": "le la les et des du une dans qui par pour au sur pas plus avec est elle".split(),
    "es": "el los las y del se con por su para como una lo al que no más".split(),
}
LANGUAGES = ("none", *FUNCTION_WORDS)
BUCKETS, WIDTHS = 1 << 16, (1, 2, 3)
EDGE = b".,;:!?\"'()[]{}*#$%&<>|-_"


class Words:
    """Bucket and language cue of every word, through a bounded cache."""

    def __init__(self, most: int = 400_000):
        self.most, self.known = most, {}
        self.cues = {w.encode(): i + 1 for i, (_, own) in enumerate(FUNCTION_WORDS.items()) for w in own}

    def __call__(self, text: str) -> tuple[np.ndarray, int]:
        """The three buckets of each word (bucket 0 stands for the ends), and the text's language."""
        known, words = self.known, text.lower().encode("utf-8", "replace").split()
        if len(known) > self.most:
            known.clear()
        for w in words:
            if w not in known:
                bare = w.strip(EDGE) or w
                letters = bare.decode("utf-8", "replace")
                parts = (bare, b"4" + letters[:4].encode(), b"6" + letters[:6].encode())
                a, b, c = (1 + zlib.crc32(x) % (BUCKETS - 1) for x in parts)
                known[w] = a << 40 | b << 22 | c << 4 | self.cues.get(bare, 0)
        codes = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        seen = np.bincount(codes & 15, minlength=len(LANGUAGES))[1 : len(LANGUAGES)]
        buckets = np.stack([codes >> 40, codes >> 22 & 0x3FFFF, codes >> 4 & 0x3FFFF], axis=1)
        return buckets, int(seen.argmax()) + 1 if seen.any() else 0


class ConvNet:
    """Embeddings, filters of ``WIDTHS``, max pooling, logistic output."""

    def __init__(self, size: int = 8, filters: int = 8, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.filters = filters
        self.p = {"emb": rng.normal(0, 0.1, (BUCKETS, size)).astype(np.float32), "out": np.zeros(filters * len(WIDTHS), np.float32), "bias": np.zeros(1, np.float32)}
        for w in WIDTHS:
            self.p[f"f{w}"] = rng.normal(0, 0.3, (w, size, filters)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(filters, np.float32)
        self.p["out"] += rng.normal(0, 0.1, len(self.p["out"])).astype(np.float32)
        self.shift = np.zeros(len(LANGUAGES))
        self.slope = 1.0

    def tables(self) -> None:
        """Response of every filter place to every bucket, for scoring."""
        self.table = {w: [self.p["emb"] @ self.p[f"f{w}"][j] for j in range(w)] for w in WIDTHS}

    def pooled(self, words: np.ndarray):
        """Best response of each filter, and the place it has it."""
        best, place = [], []
        for w in WIDTHS:
            padded = np.concatenate([words, np.zeros((max(w - 1, w - len(words)), 3), np.int64)])
            n, r = len(padded) - w + 1, 0.0
            for j in range(w):
                for own in padded[j : n + j].T:
                    r = r + self.table[w][j][own]
            at = r.argmax(0)
            best.append(r[at, np.arange(self.filters)] + self.p[f"b{w}"]), place.append(at)
        return np.concatenate(best), place

    def margin(self, words: np.ndarray) -> float:
        pooled, _ = self.pooled(words)
        return float(np.maximum(pooled, 0) @ self.p["out"] + self.p["bias"][0])

    def score(self, words: np.ndarray, language: int) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * (self.margin(words) - self.shift[language]), -40, 40))))

    def fit(self, rows: list[np.ndarray], labels: np.ndarray, epochs: int, batch: int = 32, rate: float = 0.02, seed: int = 12) -> None:
        """Adam on balanced classes.  The first embedding coordinate starts as a word's log odds in the labels."""
        rng = np.random.default_rng(seed)
        count = np.full((2, BUCKETS), 0.5)
        for words, y in zip(rows, labels):
            count[int(y), np.unique(words)] += 1
        total = np.array([(labels == 0).sum() + 1, (labels == 1).sum() + 1])
        odds = np.log(count[1] / total[1]) - np.log(count[0] / total[0])
        self.p["emb"][:, 0] = np.clip(odds - odds[0], -4, 4) / 4
        weight = np.where(labels == 1, total.sum() / (2 * total[1]), total.sum() / (2 * total[0]))
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        step, steps = 0, epochs * -(-len(rows) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for i in range(0, len(order), batch):
                step += 1
                g = {k: np.zeros_like(v) for k, v in self.p.items() if k != "emb"}
                hit, d_emb = [], []
                for r in order[i : i + batch].tolist():
                    self.gradient(rows[r], labels[r], weight[r] / batch, g, hit, d_emb)
                rows_of, where = np.unique(np.concatenate(hit), return_inverse=True)
                own = np.zeros((len(rows_of), self.p["emb"].shape[1]), np.float32)
                np.add.at(own, where, np.concatenate(d_emb))
                pace = rate * (1 - step / (steps + 1))
                for k in g:
                    self.adam(first[k], second[k], g[k], self.p[k], slice(None), pace, step)
                self.adam(first["emb"], second["emb"], own, self.p["emb"], rows_of, pace, step)
        self.tables()

    @staticmethod
    def adam(first, second, g, p, at, pace, step) -> None:
        first[at] = 0.9 * first[at] + 0.1 * g
        second[at] = 0.999 * second[at] + 0.001 * g**2
        p[at] -= pace * (first[at] / (1 - 0.9**step)) / (np.sqrt(second[at] / (1 - 0.999**step)) + 1e-8)

    def gradient(self, words, label, weight, g, hit, d_emb) -> None:
        pooled, place, emb = [], [], self.p["emb"]
        padded = np.concatenate([words, np.zeros((max(2, 3 - len(words)), 3), np.int64)])
        rows = emb[padded].sum(1)
        for w in WIDTHS:
            n = max(1, len(words))
            r = rows[:n] @ self.p[f"f{w}"][0]
            for j in range(1, w):
                r += rows[j : n + j] @ self.p[f"f{w}"][j]
            at = r.argmax(0)
            place.append(at), pooled.append(r[at, np.arange(self.filters)] + self.p[f"b{w}"])
        pooled = np.concatenate(pooled)
        active = np.maximum(pooled, 0)
        d = weight * (1 / (1 + np.exp(-(active @ self.p["out"] + self.p["bias"][0]))) - label)
        g["out"] += d * active
        g["bias"] += d
        back = d * self.p["out"] * (pooled > 0)
        for k, w in enumerate(WIDTHS):
            own = back[k * self.filters : (k + 1) * self.filters]
            g[f"b{w}"] += own
            for j in range(w):
                at = place[k] + j
                g[f"f{w}"][j] += (rows[at] * own[:, None]).T
                hit.append(padded[at].ravel()), d_emb.append(np.repeat(own[:, None] * self.p[f"f{w}"][j].T, 3, axis=0))

    def calibrate(self, margins: np.ndarray, labels: np.ndarray, languages: np.ndarray) -> None:
        """Per language the threshold with the best balanced accuracy, midway in the gap it leaves; languages with few
        labels of either kind take that of all rows.  The slope fits the likelihood best."""
        def threshold(m, y):
            order = np.argsort(m, kind="stable")
            m, y = m[order], y[order]
            right = np.concatenate([[0], np.cumsum(y == 0)]) / max(1, (y == 0).sum()) + (
                (y == 1).sum() - np.concatenate([[0], np.cumsum(y == 1)])) / max(1, (y == 1).sum())
            cut = np.concatenate([[m[0] - 1], (m[1:] + m[:-1]) / 2, [m[-1] + 1]])
            best = np.flatnonzero(right == right.max())
            return float(cut[best[len(best) // 2]])

        both = len(labels) and 0 < labels.sum() < len(labels)
        self.shift[:] = threshold(margins, labels) if both else 0.0
        for k in range(len(LANGUAGES)):
            own = languages == k
            if both and min(labels[own].sum(), (1 - labels[own]).sum()) >= 10:
                self.shift[k] = threshold(margins[own], labels[own])
        x = margins - self.shift[languages] if len(margins) else margins
        slopes = np.geomspace(0.25, 8, 16)
        self.slope = float(slopes[np.argmin([np.logaddexp(0, np.where(labels == 1, -s * x, s * x)).mean() for s in slopes])]) if both else 1.0


def scored(df: DataFrame, model: ConvNet, text: str = "text", score: str = "score") -> DataFrame:
    """Adds ``score`` (0 to 1) of the whole text; null and empty texts get that of an empty word sequence.  Nothing but
    the text is read; other columns and repeated rows stay."""
    held = sent(df.sparkSession, model)

    def work(batches):
        own, words = held(), Words()
        own.tables()
        for batch in batches:
            yield with_columns(batch, {score: pa.array([own.score(*words(t)) for t in texts(batch.column(text))], pa.float64())})

    return df.mapInArrow(work, schema_with(df, f"`{score}` double"))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = 3000,
          epochs: int = 4) -> ConvNet:
    """Fitted on the driver on the whole texts of at most ``most`` labelled rows, half of them of each label.  A fifth
    is left out of the fit and serves calibration together with the rest."""
    words, model = Words(), ConvNet()
    rows = labelled_sample(docs.select(key, text), labels, key, label, most).select(F.coalesce(text, F.lit("")).alias("t"), F.col(label).alias("y"))
    own = [(zlib.crc32(r.t.encode()), *words(r.t), r.y) for r in rows.toLocalIterator()]
    own.sort(key=lambda x: (x[0], len(x[1]), x[3]))
    codes, languages, labels = [x[1] for x in own], np.array([x[2] for x in own], np.int64), np.array([x[3] for x in own], np.float64)
    held = np.arange(len(own)) % 5 == 4
    if len(own):
        model.fit([c for c, h in zip(codes, held) if not h], labels[~held], max(epochs, min(30, epochs * 800 // len(own))))
        model.calibrate(np.array([model.margin(c) for c in codes]), labels, languages)
        del model.table  # made anew in tasks, so that only the parameters travel
    return model

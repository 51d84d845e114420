"""A character tagger: bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

import numpy as np

CHARS = 134  # ASCII, then five classes of other characters


def char_ids(text: str) -> np.ndarray:
    """One small number per code point."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    wide = np.flatnonzero(code > 127)
    for i in wide.tolist():
        c = text[i]
        code[i] = 128 if c.isalpha() else 129 if c.isdigit() else 130 if c.isspace() else 131
    return code


def logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Tagger:
    """Tags 0 (outside) and, for kind k, 2k+1 (begin) and 2k+2 (inside)."""

    def __init__(self, kinds: int, width: int = 10, hidden: int = 16, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.tags, self.hidden = 2 * kinds + 1, hidden
        self.p = {
            "emb": rng.normal(0, 0.5, (CHARS, width)), "wx": rng.normal(0, width**-0.5, (2, width, 4 * hidden)),
            "wh": rng.normal(0, hidden**-0.5, (2, hidden, 4 * hidden)), "b": np.zeros((2, 1, 4 * hidden)),
            "out": rng.normal(0, hidden**-0.5, (2 * hidden, self.tags)), "bias": np.zeros(self.tags), "trans": np.zeros((self.tags, self.tags)),
        }
        self.p["b"][:, :, hidden : 2 * hidden] = 1.0
        self.barred = np.zeros((self.tags, self.tags))
        for inside in range(2, self.tags, 2):
            self.barred[:, inside] = -1e4
            self.barred[[inside - 1, inside], inside] = 0.0
        self.opening = np.array([-1e4 if t and t % 2 == 0 else 0.0 for t in range(self.tags)])

    def run(self, ids: np.ndarray, keep: bool = False):
        """Emission scores of windows ``ids (n, steps)``; padding is id 132."""
        p, (n, steps), h = self.p, ids.shape, self.hidden
        gates_of = p["emb"] @ p["wx"] + p["b"]
        both = np.stack([ids, ids[:, ::-1]])
        state, cell = np.zeros((2, n, h)), np.zeros((2, n, h))
        out, log = np.empty((2, n, steps, h)), []
        for t in range(steps):
            g = np.stack([gates_of[0][both[0, :, t]], gates_of[1][both[1, :, t]]]) + state @ p["wh"]
            s = 1 / (1 + np.exp(-g[..., : 3 * h]))
            i, f, o, u = s[..., :h], s[..., h : 2 * h], s[..., 2 * h :], np.tanh(g[..., 3 * h :])
            old, cell = cell, f * cell + i * u
            squashed = np.tanh(cell)
            if keep:
                log.append((i, f, o, u, old, squashed, state))
            state = o * squashed
            out[:, :, t] = state
        joined = np.concatenate([out[0], out[1][:, ::-1]], axis=2)
        scores = joined @ p["out"] + p["bias"]
        return (scores, joined, both, log) if keep else scores

    def crf(self, scores: np.ndarray, gold: np.ndarray):
        """Mean loss, and its gradients by the scores and by the transitions."""
        n, steps, k = scores.shape
        trans = self.p["trans"] + self.barred
        ahead, back = np.empty_like(scores), np.zeros_like(scores)
        ahead[:, 0] = scores[:, 0] + self.opening
        for t in range(1, steps):
            ahead[:, t] = logsum(ahead[:, t - 1, :, None] + trans[None], 1) + scores[:, t]
        for t in range(steps - 2, -1, -1):
            back[:, t] = logsum(trans[None] + (scores[:, t + 1] + back[:, t + 1])[:, None, :], 2)
        total = logsum(ahead[:, -1], 1)
        share = np.exp(ahead + back - total[:, None, None])
        rows, at = np.arange(n)[:, None], np.arange(steps)[None, :]
        d_trans = np.zeros((k, k))
        path = scores[rows, at, gold].sum(1) + trans[gold[:, :-1], gold[:, 1:]].sum(1)
        for t in range(1, steps):
            pair = ahead[:, t - 1, :, None] + trans[None] + (scores[:, t] + back[:, t])[:, None, :] - total[:, None, None]
            d_trans += np.exp(pair).sum(0)
        np.subtract.at(d_trans, (gold[:, :-1], gold[:, 1:]), 1.0)
        share[rows, at, gold] -= 1.0
        return float((total - path).mean()), share / n, d_trans / n

    def gradients(self, ids: np.ndarray, gold: np.ndarray):
        p, h = self.p, self.hidden
        scores, joined, both, log = self.run(ids, keep=True)
        loss, d_scores, d_trans = self.crf(scores, gold)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["trans"], g["bias"] = d_trans, d_scores.sum((0, 1))
        g["out"] = np.tensordot(joined, d_scores, ([0, 1], [0, 1]))
        d_joined = d_scores @ p["out"].T
        d_out = np.stack([d_joined[..., :h], d_joined[:, ::-1, h:]])
        d_state, d_cell = np.zeros((2, len(ids), h)), np.zeros((2, len(ids), h))
        d_gates_of = np.zeros((2, CHARS, 4 * h))
        for t in range(ids.shape[1] - 1, -1, -1):
            i, f, o, u, old, squashed, before = log[t]
            d_state = d_state + d_out[:, :, t]
            d_cell = d_cell + d_state * o * (1 - squashed**2)
            dg = np.concatenate([d_cell * u * i * (1 - i), d_cell * old * f * (1 - f), d_state * squashed * o * (1 - o), d_cell * i * (1 - u**2)], axis=2)
            g["wh"] += before.transpose(0, 2, 1) @ dg
            for d in (0, 1):
                np.add.at(d_gates_of[d], both[d, :, t], dg[d])
            d_state, d_cell = dg @ p["wh"].transpose(0, 2, 1), d_cell * f
        g["wx"] = np.einsum("vw,dvg->dwg", p["emb"], d_gates_of)
        g["emb"] = np.einsum("dvg,dwg->vw", d_gates_of, p["wx"])
        g["b"] = d_gates_of.sum(1, keepdims=True)
        return loss, g

    def fit(self, ids: np.ndarray, gold: np.ndarray, steps: int, batch: int = 32, rate: float = 0.02, seed: int = 6) -> list[float]:
        """Adam over shuffled batches; returns the losses."""
        rng, losses = np.random.default_rng(seed), []
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        order = np.zeros(0, np.int64)
        for step in range(1, steps + 1):
            if len(order) < batch:
                order = np.concatenate([order, rng.permutation(len(ids))])
            own, order = order[:batch], order[batch:]
            loss, g = self.gradients(ids[own], gold[own])
            losses.append(loss)
            norm = max(1.0, float(np.sqrt(sum((x**2).sum() for x in g.values()))) / 5)
            pace = rate * (1 - step / (steps + 1))
            for k, x in g.items():
                x = x / norm
                first[k] = 0.9 * first[k] + 0.1 * x
                second[k] = 0.999 * second[k] + 0.001 * x**2
                self.p[k] -= pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return losses

    def best_paths(self, scores: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        """Most likely tags of each row over its own length."""
        n, steps, k = scores.shape
        trans = self.p["trans"] + self.barred
        best, source = scores[:, 0] + self.opening, np.zeros((n, steps, k), np.int8)
        ends = np.where((lengths == 1)[:, None], best, 0.0)
        for t in range(1, steps):
            step = best[:, :, None] + trans[None]
            source[:, t] = step.argmax(1)
            best = step.max(1) + scores[:, t]
            ends = np.where((lengths == t + 1)[:, None], best, ends)
        tag = ends.argmax(1)
        out = np.zeros((n, steps), np.int64)
        for t in range(steps - 1, -1, -1):
            active = t < lengths
            out[active, t] = tag[active]
            moved = source[np.arange(n), t, tag]
            tag = np.where(active & (t > 0), moved, tag)
        return [row[:m] for row, m in zip(out, lengths)]

"""A linear-chain conditional random field over short sequences, in numpy.

Places bear dense features and sparse ones (hashed, with values); all sequences of a batch are
fitted or tagged together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


#: Steps of a fit at least, for few sequences.
LEAST_STEPS = 150


@dataclass
class Places:
    """The places of all sequences, one after another: dense features, sparse ones as (row, col, value), and
    the length of each sequence."""

    dense: np.ndarray
    row: np.ndarray
    col: np.ndarray
    value: np.ndarray
    length: np.ndarray

    def some(self, sequences: np.ndarray, begin: np.ndarray, nnz: np.ndarray) -> Places:
        """The given sequences alone. begin: first place of each; nnz: first sparse entry of each place; rows are in order."""
        at = np.concatenate([np.arange(begin[i], begin[i] + self.length[i]) for i in sequences])
        size = nnz[at + 1] - nnz[at]
        row = np.repeat(np.arange(len(at)), size)
        entry = np.repeat(nnz[at], size) + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        return Places(self.dense[at], row, self.col[entry], self.value[entry], self.length[sequences])


class Chain:
    """Scores dense @ emit + sum of sparse weights + move[previous, next] for tags 0..k-1."""

    def __init__(self, features: int, bins: int, tags: int):
        self.emit, self.bins = np.zeros((features, tags)), np.zeros((bins, tags))
        self.move, self.start = np.zeros((tags, tags)), np.zeros(tags)

    def scores(self, p: Places) -> np.ndarray:
        out = p.dense @ self.emit
        for k in range(out.shape[1]):
            out[:, k] += np.bincount(p.row, weights=self.bins[p.col, k] * p.value, minlength=len(out))
        return out

    def fit(self, p: Places, tags: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, sparse_ridge: float = 3e-3, epochs: int = 10, size: int = 256, rate: float = 0.08, seed: int = 1) -> Chain:
        """Maximum conditional likelihood with a ridge penalty, by Adam on batches of ``size`` sequences, the rate falling to
        a tenth. weight: of each sequence."""
        n = len(p.length)
        r = np.random.default_rng(seed)
        order = np.argsort(p.row, kind="stable")
        p = Places(p.dense, p.row[order], p.col[order], p.value[order], p.length)
        begin = np.cumsum(p.length) - p.length
        nnz = np.searchsorted(p.row, np.arange(len(p.dense) + 1))  # rows are in order
        theta = [self.emit, self.bins, self.move, self.start]
        m, v = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
        epochs = max(epochs, -(-LEAST_STEPS // -(-n // size)))
        steps, step = epochs * -(-n // size), 0
        for _ in range(epochs):
            order = r.permutation(n)
            for at in range(0, n, size):
                step += 1
                own = order[at : at + size]
                part, y = p.some(own, begin, nnz), tags[np.concatenate([np.arange(begin[i], begin[i] + p.length[i]) for i in own])]
                grads = self._gradients(part, y, weight[own])
                grads[0] += ridge * self.emit
                grads[1] += sparse_ridge * self.bins
                grads[2] += ridge * self.move
                pace = rate * (1 - 0.9 * step / steps)
                for j, g in enumerate(grads):
                    m[j] = 0.9 * m[j] + 0.1 * g
                    v[j] = 0.99 * v[j] + 0.01 * g * g
                    theta[j] -= pace * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.99**step)) + 1e-8)
        return self

    def _gradients(self, p: Places, tags: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        n, k, longest = len(p.length), self.emit.shape[1], int(p.length.max())
        live = np.arange(longest) < p.length[:, None]
        y = np.zeros((n, longest), int)
        y[live] = tags
        goal = np.eye(k)[y] * live[:, :, None]
        pairs = np.zeros((k, k))
        both = live[:, 1:] & live[:, :-1]
        np.add.at(pairs, (y[:, :-1][both], y[:, 1:][both]), np.broadcast_to(weight[:, None], both.shape)[both])
        scores = np.zeros((n, longest, k))
        scores[live] = self.scores(p)
        one, two = self._marginals(scores, live, weight)
        r = (one - goal)[live] * np.repeat(weight, p.length)[:, None]
        sparse = np.stack([np.bincount(p.col, weights=r[p.row, j] * p.value, minlength=len(self.bins)) for j in range(k)], 1)
        total = weight.sum()
        return [p.dense.T @ r / total, sparse / total, (two - pairs) / total, ((one - goal)[:, 0] * weight[:, None]).sum(0) / total]

    def _marginals(self, scores: np.ndarray, live: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of each tag at each place, and (weighted) expected counts of tag pairs."""
        n, longest, k = scores.shape
        weight = np.ones(n) if weight is None else weight
        a = np.zeros((n, longest, k))
        a[:, 0] = self.start + scores[:, 0]
        for t in range(1, longest):
            nxt = _logsum(a[:, t - 1, :, None] + self.move, 1) + scores[:, t]
            a[:, t] = np.where(live[:, t, None], nxt, a[:, t - 1])
        total = _logsum(a[:, -1], 1)
        b = np.zeros((n, longest, k))
        for t in range(longest - 2, -1, -1):
            back = _logsum(self.move + (scores[:, t + 1] + b[:, t + 1])[:, None, :], 2)
            b[:, t] = np.where(live[:, t + 1, None], back, 0)
        one = np.exp(a + b - total[:, None, None]) * live[:, :, None]
        two = np.zeros((k, k))
        for t in range(1, longest):
            p = np.exp(a[:, t - 1, :, None] + self.move + (scores[:, t] + b[:, t])[:, None, :] - total[:, None, None])
            two += (p * weight[:, None, None])[live[:, t]].sum(0)
        return one, two

    def tag(self, p: Places) -> np.ndarray:
        """The likeliest tags of all places: Viterbi over the sequences side by side, the longest first, so that each
        step looks only at those that are that long."""
        s = self.scores(p)
        n = len(p.length)
        begin = np.cumsum(p.length) - p.length
        order = np.argsort(-p.length, kind="stable")
        begin, length = begin[order], p.length[order]
        out = np.zeros(len(s), np.int64)
        if not n or not len(s):
            return out
        alive = np.searchsorted(-length, -np.arange(1, int(length[0]) + 1), "right")  # sequences of at least so many places
        best = self.start + s[begin[: alive[0]]]
        came = []
        last = best.copy()
        for t in range(1, len(alive)):
            now = alive[t]
            reach = best[:now, :, None] + self.move
            came.append(reach.argmax(1).astype(np.int8))
            best = reach.max(1) + s[begin[:now] + t]
            last[:now] = best
        tag = last.argmax(1)
        for t in range(len(alive) - 1, -1, -1):
            now = alive[t]
            out[begin[:now] + t] = tag[:now]
            if t:
                tag[:now] = came[t - 1][np.arange(now), tag[:now]]
        return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + np.squeeze(top, axis)

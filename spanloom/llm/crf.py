"""Linear-chain conditional random field over ragged batches of sequences."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Chains:
    """Sequences of the given lengths in one batch, laid out by time so that a step is one array operation."""

    order: np.ndarray  # sequences, longest first
    place: np.ndarray  # position in time order of each element in sequence order
    active: np.ndarray  # sequences still running at each time
    start: np.ndarray  # where each time begins

    @classmethod
    def of(cls, lengths: np.ndarray) -> Chains:
        lengths = np.asarray(lengths, np.int64)
        order = np.argsort(-lengths, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        longest = int(lengths.max(initial=0))
        ends = np.bincount(lengths, minlength=longest + 1)
        active = len(lengths) - np.cumsum(ends)[:longest]
        start = np.concatenate([[0], np.cumsum(active)])
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else lengths
        time = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
        return cls(order, start[time] + np.repeat(rank, lengths), active, start)


def forward_backward(emission: np.ndarray, chains: Chains, move: np.ndarray, begin: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Marginals of each element, expected moves, expected first labels and the sum of log normalisers.

    ``emission`` is in log space, in sequence order; ``move`` and ``begin`` too.
    """
    n, k = emission.shape
    kind = emission.dtype
    top = emission.max(axis=1) if n else np.zeros(0, kind)
    e = np.empty((k, n), kind)  # labels by elements: a step works on long rows
    for j in range(k):
        e[j, chains.place] = np.exp(emission[:, j] - top)
    step, first = np.exp(move).astype(kind), np.exp(begin).astype(kind)
    back, forth = np.ascontiguousarray(step), np.ascontiguousarray(step.T)
    alpha, scale = np.empty_like(e), np.empty(n, kind)
    at = chains.start.tolist()
    times = len(chains.active)
    for t in range(times):
        a, z = at[t], at[t + 1]
        now = (first[:, None] if t == 0 else forth @ alpha[:, at[t - 1] : at[t - 1] + z - a]) * e[:, a:z]
        s = now.sum(axis=0)
        scale[a:z] = s
        np.divide(now, s, out=alpha[:, a:z])
    beta, moves = np.ones_like(e), np.zeros((k, k))
    e /= scale
    for t in range(times - 2, -1, -1):
        a, z, b = at[t + 1], at[t + 2], at[t]
        inner = e[:, a:z] * beta[:, a:z]
        if pairs:
            moves += (alpha[:, b : b + z - a] @ inner.T) * step
        np.matmul(back, inner, out=beta[:, b : b + z - a])
    alpha *= beta
    alpha /= alpha.sum(axis=0)
    firsts = alpha[:, : chains.active[0]].sum(axis=1) if times else np.zeros(k)
    return alpha[:, chains.place].T, moves, firsts, float(np.log(scale).sum() + top.sum())


class Adam:
    """Adam over named arrays, ascending."""

    def __init__(self, rate: float):
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def begin(self) -> None:
        self.t += 1

    def step(self, name: str, value: np.ndarray, grad: np.ndarray) -> None:
        m = self.m[name] = 0.9 * self.m.get(name, 0.0) + 0.1 * grad
        v = self.v[name] = 0.999 * self.v.get(name, 0.0) + 0.001 * grad**2
        value += self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def gold_counts(labels: np.ndarray, lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One-hot labels, observed moves and observed first labels."""
    hot = np.eye(k)[labels]
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    inside = np.ones(len(labels), bool)
    inside[first] = False
    at = np.flatnonzero(inside)
    moves = np.bincount(labels[at - 1] * k + labels[at], minlength=k * k).reshape(k, k).astype(float)
    return hot, moves, np.bincount(labels[first], minlength=k).astype(float)

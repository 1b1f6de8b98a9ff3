"""Numpy steps of the latent-state model, run on Arrow batches inside Spark tasks.

A batch holds many sequence segments end to end: ``start``/``length`` delimit them, ``log_f`` has
one row of K emission log-likelihoods per position.  All steps run over the segments of a batch at
once; segments are visited longest first, so that at step t the active ones are a prefix.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Sums of products below this are taken by logarithms instead, so that nothing is lost to underflow.
FAINT = 1e-150


def log_normalise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``exp(x)`` scaled to sum 1, and the log of the scale; an impossible row gives 0, -inf."""
    top = x.max(axis=1)
    safe = np.where(np.isfinite(top), top, 0.0)
    e = np.exp(x - safe[:, None])
    z = e.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        q = np.where(z[:, None] > 0, e / z[:, None], 0.0)
        return q, np.where(z > 0, safe + np.log(z), -np.inf)


def update(log_f: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filtered state and log normaliser from the predicted state and the evidence."""
    with np.errstate(divide="ignore"):
        return log_normalise(np.log(prior) + log_f)


def ratio(num: np.ndarray, den: np.ndarray) -> np.ndarray:
    """Division with 0/0 = 0."""
    return np.divide(num, den, out=np.zeros_like(num), where=den > 0)


def emission(log_v: np.ndarray, items: np.ndarray, counts: np.ndarray, first: np.ndarray | None):
    """``sum n * ln V[item]`` per position; ``first`` marks where a position's entries begin."""
    f = log_v[items]
    if first is None:
        return f
    return np.add.reduceat(f * counts[:, None], first, axis=0)


def by_length(length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segment order, longest first, and how many segments are active at each step."""
    order = np.argsort(-length, kind="stable")
    steps = int(length.max())
    active = np.searchsorted(-length[order], -np.arange(steps), side="left")
    return order, active


@dataclass
class Walk:
    """The order in which the steps visit the positions of many segments.

    ``order``: segments, longest first; ``active``: how many of them each step has; ``at``: the positions, step by step;
    ``edge``: where each step begins in ``at``.
    """

    order: np.ndarray
    active: np.ndarray
    at: np.ndarray
    edge: np.ndarray
    #: Where the last position of each segment (in ``order``) is.
    ends: np.ndarray

    def placed(self, columns: np.ndarray) -> np.ndarray:
        """One column per visit as one row per position."""
        out = np.empty((columns.shape[1], len(columns)))
        out[self.at] = columns.T
        return out


def walk(start: np.ndarray, length: np.ndarray) -> Walk:
    order, active = by_length(length)
    first = start[order]
    at = np.concatenate([first[:m] + t for t, m in enumerate(active)])
    edge = np.r_[0, np.cumsum(active)]
    return Walk(order, active, at, edge, edge[length[order] - 1] + np.arange(len(order)))


def filtered(f, way: Walk, trans, begin):
    """``forward`` with evidence ``f`` by visit; ``q`` and ``p`` have one row per state, so that a step is a few long rows."""
    n, k = f.shape
    top = f.max(axis=1)
    top = np.where(np.isfinite(top), top, 0.0)
    weight = np.ascontiguousarray(f.T)
    weight = np.exp(np.subtract(weight, top, out=weight), out=weight)
    q, p, z = np.empty((k, n)), np.empty((k, n)), np.empty(n)
    again = []
    state = np.ascontiguousarray(begin[way.order].T)
    for t, m in enumerate(way.active):
        here = slice(way.edge[t], way.edge[t + 1])
        p[:, here] = state[:, :m]
        x = state[:, :m] * weight[:, here]
        mass = x.sum(axis=0)
        few = np.flatnonzero(mass < FAINT)
        if len(few):
            # products too small to carry the result: these again by logarithms
            exact, scale = update(f[here][few], state[:, few].T)
            mass[few], x[:, few] = 1.0, exact.T
            again.append((few + way.edge[t], scale))
        z[here] = mass
        x /= mass
        q[:, here] = x
        state[:, :m] = trans.T @ x
    c = top + np.log(z)
    for rows, scale in again:
        c[rows] = scale
    after = np.empty((len(way.order), k))
    after[way.order] = state.T
    return q, p, c, after


def smoothed(q, p, way: Walk, trans, after, future):
    """``backward`` by visit, one row per state."""
    g, r = np.empty_like(q), np.empty_like(q)
    mass = (after * future).sum(axis=1, keepdims=True)
    r[:, way.ends] = ratio(future, np.broadcast_to(mass, future.shape))[way.order].T
    for t in range(len(way.active) - 1, -1, -1):
        here = slice(way.edge[t], way.edge[t + 1])
        if t + 1 < len(way.active):
            later = slice(way.edge[t + 1], way.edge[t + 2])
            r[:, way.edge[t] : way.edge[t] + way.active[t + 1]] = ratio(g[:, later], p[:, later])
        g[:, here] = q[:, here] * (trans @ r[:, here])
    return g, r


def forward(log_f, start, length, trans, begin):
    """Filter all segments.  ``begin`` is the predicted state at the first position of each.

    Returns filtered ``q``, predicted ``p`` (both per position), the log normaliser per position
    and the predicted state after the last position of each segment.
    """
    way = walk(start, length)
    q, p, c, after = filtered(log_f[way.at], way, trans, begin)
    return way.placed(q), way.placed(p), way.placed(c[None])[:, 0], after


def backward(q, p, start, length, trans, after, future):
    """Smooth all segments.  ``future`` is the likelihood of what follows each segment, per state
    of the next position, up to scale; all ones where nothing follows.

    Returns the smoothed state per position and, per position, the factor ``g/p`` of its successor
    that the transition statistics need.
    """
    way = walk(start, length)
    g, r = smoothed(q[way.at].T, p[way.at].T, way, trans, after, future)
    return way.placed(g), way.placed(r)


def sum_by_item(items: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct items and the sum of their rows."""
    if len(items) and 0 <= items.min() and items.max() <= len(items):
        found = np.flatnonzero(np.bincount(items))
        sums = [np.bincount(items, np.ascontiguousarray(column)) for column in rows.T]
        return found.astype(items.dtype), np.stack([column[found] for column in sums], axis=1)
    order = np.argsort(items, kind="stable")
    ids = items[order]
    cut = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    return ids[cut], np.add.reduceat(rows[order], cut, axis=0)


def transfer(log_f, start, length, trans):
    """Per segment the K x K operator that maps the predicted state at its first position to the
    unnormalised predicted state after its last one, scaled to a largest entry of 1."""
    k = trans.shape[0]
    order, active = by_length(length)
    first = start[order]
    op = np.broadcast_to(np.eye(k), (len(order), k, k)).copy()
    for t, m in enumerate(active):
        f = log_f[first[:m] + t]
        top = f.max(axis=1, keepdims=True)
        w = np.exp(f - np.where(np.isfinite(top), top, 0.0))
        op[:m] = (op[:m] * w[:, None, :]) @ trans
        op[:m] = scaled(op[:m])
    out = np.empty_like(op)
    out[order] = op
    return out


def scaled(op: np.ndarray) -> np.ndarray:
    """Divide each operator by its largest entry; only directions matter for what it is used for."""
    top = op.max(axis=(-2, -1), keepdims=True)
    return np.divide(op, top, out=np.zeros_like(op), where=top > 0)


def stationary(trans: np.ndarray, rounds: int = 14) -> np.ndarray:
    """Rows of ``trans`` to the power ``2**rounds``."""
    for _ in range(rounds):
        trans = trans @ trans
    return trans

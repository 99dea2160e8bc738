"""Special functions on numpy arrays (no scipy here) and sampling from log scores."""

from __future__ import annotations

import math

import numpy as np

_SERIES = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)


def lgamma(x) -> np.ndarray:
    """log Gamma for positive arguments: those below 8 are shifted by 8 by the recurrence, then Stirling's series."""
    x = np.asarray(x, np.float64)
    if x.size < 300:  # few: the calls of array functions would cost more
        return np.array([*map(math.lgamma, x.ravel().tolist())]).reshape(x.shape)
    low = x < 8
    prod = 1.0
    if low.any():
        y = np.where(low, x, 1.0)
        prod = y * (y + 1)
        for k in range(2, 8):
            prod = prod * (y + k)
        prod = np.where(low, prod, 1.0)
    z = np.where(low, x + 8, x)
    inv = 1 / z
    sq = inv * inv
    tail = inv * (_SERIES[0] + sq * (_SERIES[1] + sq * (_SERIES[2] + sq * (_SERIES[3] + sq * _SERIES[4]))))
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + tail - np.log(prod)


def log_sum_exp(x: np.ndarray, axis: int = -1) -> np.ndarray:
    """log of the sum of exponentials; -inf for an empty axis."""
    x = np.asarray(x, np.float64)
    if x.shape[axis] == 0:
        return np.full(np.delete(x.shape, axis), -np.inf)
    m = x.max(axis=axis, keepdims=True)
    m = np.where(np.isfinite(m), m, 0)
    with np.errstate(divide="ignore"):
        return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


def choose(rng: np.random.Generator, scores: np.ndarray) -> int:
    """One index drawn in proportion to exp(scores)."""
    c = np.exp(scores - scores.max()).cumsum()
    return min(int(c.searchsorted(rng.random() * c[-1], "right")), len(c) - 1)


def choose_rows(u: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """One column index per row of scores, from uniform numbers u."""
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    c = np.cumsum(p, axis=1)
    return np.minimum((c < (u * c[:, -1])[:, None]).sum(axis=1), scores.shape[1] - 1)


def choose_coded(u: np.ndarray, scores: np.ndarray, code: np.ndarray) -> np.ndarray:
    """One column index for each of code, from uniform numbers u and the row of scores that it names."""
    if len(scores) * 4 > len(u):  # most rows differ
        return choose_rows(u, scores[code])
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    c, out = np.cumsum(p, axis=1), np.empty(len(u), np.int64)
    order = np.argsort(code, kind="stable")
    ends = np.cumsum(np.bincount(code, minlength=len(scores)))
    for i, rows in enumerate(np.split(order, ends[:-1])):
        if len(rows):
            out[rows] = np.minimum(c[i].searchsorted(u[rows] * c[i, -1], "left"), c.shape[1] - 1)
    return out


def deal(rng: np.random.Generator, scores: np.ndarray, code: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns of counts[i] equal rows each, drawn by the row of scores that code[i] names: i, column, and how many of them (parts of an i can repeat).

    Where there are more equal rows than columns, their numbers by column are drawn at once.
    """
    width = scores.shape[1]
    few = counts <= width
    at = np.repeat(np.flatnonzero(few), counts[few])
    g = choose_coded(rng.random(len(at)), scores, code[at]) if len(at) else np.zeros(0, np.int64)
    if few.all():
        return at, g, np.ones(len(at))
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    many = np.flatnonzero(~few)
    n = rng.multinomial(counts[many], p[code[many]])
    i, h = np.nonzero(n)
    return np.concatenate([at, many[i]]), np.concatenate([g, h]), np.concatenate([np.ones(len(at)), n[i, h]])


def hash_units(ids: np.ndarray, *seed: int) -> np.ndarray:
    """Uniform numbers that depend on the ids and the seed alone (splitmix64)."""
    mix = 0
    for s in seed:
        mix = (mix * 0x9E3779B97F4A7C15 + s + 0x1234567) & 0xFFFFFFFFFFFFFFFF
    with np.errstate(over="ignore"):
        z = ids.astype(np.int64).astype(np.uint64) + np.uint64(mix)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return ((z >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)

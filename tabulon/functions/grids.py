"""Grids of hyperparameters: points between two ends, dense where the name says, and the grids that models choose from."""

from __future__ import annotations

from functools import cache

import numpy as np


def uniform(low: float, high: float, count: int) -> np.ndarray:
    """Middles of `count` equal intervals."""
    return low + (high - low) * (np.arange(count) + 0.5) / count


def center_heavy(low: float, high: float, count: int) -> np.ndarray:
    """Dense round the middle: the arcsine of equally spaced points, mapped to the ends."""
    return low + (high - low) * (0.5 + np.arcsin(uniform(-1.0, 1.0, count)) / np.pi)


def left_heavy(low: float, high: float, count: int) -> np.ndarray:
    """Dense at the low end: squares of equally spaced points, mapped to the ends."""
    return low + (high - low) * np.square(uniform(0.0, 1.0, count))


def right_heavy(low: float, high: float, count: int) -> np.ndarray:
    """Dense at the high end: the mirror image of left_heavy, in rising order."""
    return low + high - left_heavy(low, high, count)[::-1]


@cache
def pitman_yor(least_alpha: float = 0.1, most_alpha: float = 100.0, least_d: float = 0.0, most_d: float = 0.5, alphas: int = 20, ds: int = 10) -> tuple[tuple[float, float], ...]:
    """Pairs (alpha, d): alpha on a logarithmic scale, and the smaller the alpha the more values of d; the two scales' places add up to less than 1."""
    x, y = center_heavy(0.0, 1.0, alphas)[:, None], left_heavy(0.0, 1.0, ds)[None, :]
    i, j = np.nonzero(x + y < 1)
    a = least_alpha * np.exp(np.log(most_alpha / least_alpha) * x[i, 0])
    return tuple(zip(a.tolist(), (least_d + (most_d - least_d) * y[0, j]).tolist()))


def _decades(low: float, high: float, count: int) -> np.ndarray:
    """Equally spaced powers of ten, ends included."""
    return np.power(10.0, np.linspace(low, high, count))


@cache
def of_model(name: str) -> dict[str, np.ndarray]:
    """The grids of a feature model's hyperparameters. Exponents of ten and numbers of points."""
    wide = _decades(-8, 8, 100)
    return {
        "bb": {"alpha": _decades(-1, 2, 12), "beta": _decades(-1, 2, 12)},
        "dd": {"alphas": _decades(-1, 2, 12)},
        "dpd": {"gamma": np.power(10.0, left_heavy(-1, 2, 30)), "alpha": np.power(10.0, right_heavy(-1, 1, 20))},
        "gp": {"alpha": _decades(-1, 5, 100), "inv_beta": _decades(-5, 1, 100)},
        "nich": {"mu": np.concatenate([-wide[::-1], [0.0], wide]), "sigmasq": wide, "kappa": _decades(-2, 2, 30), "nu": _decades(0, 2, 30)},
    }[name]

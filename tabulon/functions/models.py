"""Feature models with conjugate priors, vectorised over groups, and Pitman-Yor partitions.

A model's statistics are arrays whose first axis is the group. Every model has: empty, add and remove (one row), from_rows
(a whole column by group; w: how many rows each value stands for), merge, predictive (log probability of one value under each group), table (of many values under each
group: rows x groups), marginal (log marginal likelihood per group), sample (from functions of uniform numbers, so that draws can be reproduced anywhere), and grid (hyperparameter grids by name).
Models: bb (Beta-Bernoulli), dd (Dirichlet-discrete), dpd (Dirichlet process-discrete, unbounded categories with an
OTHER bin), gp (Gamma-Poisson), nich (normal-inverse-chi-squared). Unobserved values are no part of any statistic.
"""

from __future__ import annotations

import math
from typing import Any

import numpy as np

from tabulon.functions import grids
from tabulon.functions.special import choose, lgamma

Stats = dict[str, np.ndarray]
Hypers = dict[str, Any]


class Model:
    name = ""
    fields: tuple[str, ...] = ()

    def empty(self, h: Hypers, groups: int) -> Stats:
        return {f: np.zeros(groups) for f in self.fields}

    def merge(self, a: Stats, b: Stats) -> Stats:
        return {f: a[f] + b[f] for f in a}

    def less(self, a: Stats, b: Stats) -> Stats:
        """Statistics a without the rows of b, which are among them."""
        return {f: a[f] - b[f] for f in a}

    def grid(self, h: Hypers) -> dict[str, np.ndarray]:
        return grids.of_model(self.name)

    def grid_scores(self, h: Hypers, name: str, points: np.ndarray, s: Stats) -> np.ndarray:
        """Log marginal likelihood of all groups for each value of one hyperparameter."""
        return self.marginal({**h, name: np.asarray(points, float)[:, None]}, s).sum(axis=1)

    def take(self, s: Stats, index) -> Stats:
        return {f: v[index] for f, v in s.items()}

    def extend(self, h: Hypers, s: Stats, groups: int) -> Stats:
        e = self.empty(h, groups)
        return {f: np.concatenate([s[f], e[f]]) for f in s}


class BetaBernoulli(Model):
    name, fields = "bb", ("heads", "tails")

    def default(self, values: np.ndarray) -> Hypers:
        return {"alpha": 0.5, "beta": 0.5}

    def add(self, h, s, g, x, sign=1):
        s["heads" if x else "tails"][g] += sign

    def from_rows(self, h, x, g, groups, w=None):
        heads = np.bincount(g, x.astype(float) if w is None else x * w, groups)
        return {"heads": heads, "tails": np.bincount(g, w, groups) - heads}

    def predictive(self, h, s, x):
        n = h["alpha"] + h["beta"] + s["heads"] + s["tails"]
        return np.log((h["alpha"] + s["heads"] if x else h["beta"] + s["tails"]) / n)

    def table(self, h, s, x):
        both = np.stack([self.predictive(h, s, False), self.predictive(h, s, True)])
        return both[x.astype(np.int64)]

    def marginal(self, h, s):
        a, b, p, q = h["alpha"], h["beta"], s["heads"], s["tails"]
        return lgamma(a + p) - lgamma(a) + lgamma(b + q) - lgamma(b) + lgamma(a + b) - lgamma(a + b + p + q)

    def sample(self, h, s, g, unit):
        p = (h["alpha"] + s["heads"][g]) / (h["alpha"] + h["beta"] + s["heads"][g] + s["tails"][g])
        return unit(0) < p


class DirichletDiscrete(Model):
    name, fields = "dd", ("counts",)

    def default(self, values: np.ndarray) -> Hypers:
        return {"alphas": np.full(int(values.max()) + 1 if len(values) else 1, 0.5)}

    def empty(self, h, groups):
        return {"counts": np.zeros((groups, len(h["alphas"])))}

    def add(self, h, s, g, x, sign=1):
        s["counts"][g, int(x)] += sign

    def from_rows(self, h, x, g, groups, w=None):
        v = len(h["alphas"])
        return {"counts": np.bincount(g * v + x.astype(np.int64), w, groups * v).reshape(groups, v).astype(float)}

    def probs(self, h, s):
        c = s["counts"] + h["alphas"]
        return c / c.sum(axis=1, keepdims=True)

    def predictive(self, h, s, x):
        return np.log(s["counts"][:, int(x)] + h["alphas"][int(x)]) - np.log(s["counts"].sum(axis=1) + h["alphas"].sum())

    def table(self, h, s, x):
        return np.log(self.probs(h, s)).T[x.astype(np.int64)]

    def marginal(self, h, s):
        a = h["alphas"]
        return lgamma(a.sum()) - lgamma(a.sum() + s["counts"].sum(axis=1)) + (lgamma(a + s["counts"]) - lgamma(a)).sum(axis=1)

    def code_scores(self, h, code: int, points: np.ndarray, s) -> np.ndarray:
        """Log marginal likelihood, but for what stays the same, for each value of one code's alpha."""
        a, n, rows = np.asarray(points, float)[:, None], s["counts"][:, code], s["counts"].sum(axis=1)
        total = h["alphas"].sum() - h["alphas"][code] + a
        return (lgamma(total) - lgamma(total + rows) + lgamma(a + n) - lgamma(a)).sum(axis=1)

    def sample(self, h, s, g, unit):
        c, u, out = np.cumsum(self.probs(h, s), axis=1), unit(0), np.empty(len(g), np.int64)
        for k in np.unique(g):
            at = g == k
            out[at] = np.minimum(np.searchsorted(c[k], u[at] * c[k, -1], "right"), c.shape[1] - 1)
        return out


class DirichletProcessDiscrete(DirichletDiscrete):
    """Codes 0 .. V - 1 are known symbols, V is OTHER; base weights betas sum to 1 with OTHER's share last."""

    name = "dpd"

    def default(self, values: np.ndarray) -> Hypers:
        known = int(values.max()) + 1 if len(values) else 0
        n = np.bincount(values.astype(np.int64), minlength=known) + 0.5 if known else np.zeros(0)
        w = np.append(n, 1.0)
        return {"gamma": 1.0, "alpha": 1.0, "betas": w / w.sum()}

    def empty(self, h, groups):
        return {"counts": np.zeros((groups, len(h["betas"])))}

    def _dd(self, h):
        return {"alphas": h["alpha"] * np.asarray(h["betas"])}

    def from_rows(self, h, x, g, groups, w=None):
        return super().from_rows(self._dd(h), x, g, groups, w)

    def probs(self, h, s):
        return super().probs(self._dd(h), s)

    def predictive(self, h, s, x):
        return super().predictive(self._dd(h), s, x)

    def marginal(self, h, s):
        a = self._dd(h)["alphas"]
        seen = s["counts"] > 0
        return lgamma(h["alpha"]) - lgamma(h["alpha"] + s["counts"].sum(axis=1)) + np.where(seen, lgamma(a + s["counts"]) - lgamma(a), 0).sum(axis=1)

    def grid_scores(self, h, name, points, s):
        """Of alpha; the values' base weights carry all that gamma says."""
        g, v = np.nonzero(s["counts"])
        n, w, rows = s["counts"][g, v], np.asarray(h["betas"])[v], s["counts"].sum(axis=1)
        return np.array([(lgamma(p) - lgamma(p + rows)).sum() + (lgamma(p * w + n) - lgamma(p * w)).sum() for p in np.asarray(points, float)])

    def redraw_base(self, h: Hypers, s: Stats, rng: np.random.Generator) -> Hypers:
        """gamma and the base weights, given how many tables each value has in the groups, which are drawn seat by seat.

        Only where every known value was seen; otherwise the hyperparameters stay.
        """
        tables = np.zeros(len(h["betas"]))
        for g, v in zip(*np.nonzero(s["counts"])):
            strength, c = h["alpha"] * h["betas"][v], int(s["counts"][g, v])
            first = np.arange(min(c, 1000))
            tables[v] += (rng.random(len(first)) * (strength + first) < strength).sum()
            if c > 1000:  # later seats open tables so rarely that their number is Poisson
                tables[v] += rng.poisson(strength * math.log((strength + c) / (strength + 1000)))
        if not tables[:-1].all():
            return h
        points = self.grid(h)["gamma"]
        score = len(tables[:-1]) * np.log(points) + lgamma(points) - lgamma(points + tables.sum())
        gamma = float(points[choose(rng, score)])
        betas = np.maximum(rng.dirichlet(np.append(tables[:-1], gamma)), 1e-12)
        return {**h, "gamma": gamma, "betas": betas / betas.sum()}


class GammaPoisson(Model):
    name, fields = "gp", ("n", "total", "log_prod")

    def default(self, values):
        return {"alpha": 1.0, "inv_beta": 1.0 / max(float(values.mean()) if len(values) else 1.0, 0.1)}

    def add(self, h, s, g, x, sign=1):
        s["n"][g] += sign
        s["total"][g] += sign * x
        s["log_prod"][g] += sign * math.lgamma(x + 1)

    def from_rows(self, h, x, g, groups, w=None):
        x, w = x.astype(float), np.ones(len(x)) if w is None else w
        return {"n": np.bincount(g, w, groups), "total": np.bincount(g, x * w, groups), "log_prod": np.bincount(g, lgamma(x + 1) * w, groups)}

    def predictive(self, h, s, x):
        a, b = h["alpha"] + s["total"], h["inv_beta"] + s["n"]
        return lgamma(a + x) - lgamma(a) + a * np.log(b) - (a + x) * np.log1p(b) - math.lgamma(x + 1)

    def table(self, h, s, x):
        u, inv = np.unique(x.astype(float), return_inverse=True)
        a, b = h["alpha"] + s["total"], h["inv_beta"] + s["n"]
        t = lgamma(a + u[:, None]) - lgamma(a) + a * np.log(b) - (a + u[:, None]) * np.log1p(b) - lgamma(u + 1)[:, None]
        return t[inv]

    def marginal(self, h, s):
        a, b = h["alpha"] + s["total"], h["inv_beta"] + s["n"]
        return lgamma(a) - lgamma(h["alpha"]) + h["alpha"] * np.log(h["inv_beta"]) - a * np.log(b) - s["log_prod"]

    def sample(self, h, s, g, unit):
        """By the inverse of the negative binomial's distribution function, summed from 0 on."""
        a, b = (h["alpha"] + s["total"])[g], (h["inv_beta"] + s["n"])[g]
        left, x = unit(0).copy(), np.zeros(len(g), np.int64)
        p = np.exp(a * (np.log(b) - np.log1p(b)))
        tiny = p < 1e-290  # far from 0: the normal law is as good
        if tiny.any():
            mean = a / b
            z = np.sqrt(-2 * np.log(unit(1))) * np.cos(2 * np.pi * unit(2))
            x[tiny] = np.maximum(0, np.rint(mean + z * np.sqrt(mean * (1 + 1 / b))))[tiny]
        todo, k = np.flatnonzero(~tiny & (left > p)), 0
        while len(todo) and k < 1_000_000:
            left[todo] -= p[todo]
            p[todo] *= (a[todo] + k) / ((k + 1) * (1 + b[todo]))
            k += 1
            x[todo] = k
            todo = todo[(left[todo] > p[todo]) & ((p[todo] > 1e-18) | (k < (a / b)[todo]))]
        return x


class NormalInverseChiSq(Model):
    name, fields = "nich", ("n", "mean", "m2")

    def default(self, values):
        mu, var = (float(values.mean()), float(values.var())) if len(values) else (0.0, 1.0)
        return {"mu": mu, "kappa": 0.1, "sigmasq": max(var / 10, 1e-6), "nu": 1.0}

    def add(self, h, s, g, x, sign=1):
        n = s["n"][g] + sign
        if n <= 0:
            s["n"][g] = s["mean"][g] = s["m2"][g] = 0.0
            return
        d = x - s["mean"][g]
        mean = s["mean"][g] + sign * d / n
        s["m2"][g] = max(0.0, s["m2"][g] + sign * d * (x - mean))
        s["mean"][g], s["n"][g] = mean, n

    def from_rows(self, h, x, g, groups, w=None):
        x, w = x.astype(float), np.ones(len(x)) if w is None else w
        n = np.bincount(g, w, groups)
        mean = np.bincount(g, x * w, groups) / np.maximum(n, 1)
        return {"n": n, "mean": mean, "m2": np.bincount(g, (x - mean[g]) ** 2 * w, groups)}

    def merge(self, a, b):
        n = a["n"] + b["n"]
        d = b["mean"] - a["mean"]
        safe = np.maximum(n, 1)
        return {"n": n, "mean": a["mean"] + d * b["n"] / safe, "m2": a["m2"] + b["m2"] + d * d * a["n"] * b["n"] / safe}

    def less(self, a, b):
        n = a["n"] - b["n"]
        safe = np.maximum(n, 1)
        d = a["mean"] - b["mean"]
        mean = np.where(n > 0, a["mean"] + d * b["n"] / safe, 0.0)
        return {"n": n, "mean": mean, "m2": np.where(n > 0, np.maximum(a["m2"] - b["m2"] - d * d * b["n"] * np.where(n > 0, a["n"], 0) / safe, 0.0), 0.0)}

    def posterior(self, h, s):
        n = s["n"]
        kappa, nu = h["kappa"] + n, h["nu"] + n
        mu = (h["kappa"] * h["mu"] + n * s["mean"]) / kappa
        var = (h["nu"] * h["sigmasq"] + s["m2"] + n * h["kappa"] * (h["mu"] - s["mean"]) ** 2 / kappa) / nu
        return mu, kappa, var, nu

    def predictive(self, h, s, x):
        return self.table(h, s, np.array([x]))[0]

    def table(self, h, s, x):
        if len(x) > 256:
            u, at = np.unique(np.asarray(x, float), return_inverse=True)
            if len(u) * 4 < len(x):  # a value's scores are computed once
                return self._table(h, s, u)[at]
        return self._table(h, s, x)

    def _table(self, h, s, x):
        mu, kappa, var, nu = self.posterior(h, s)
        lam = kappa / ((kappa + 1) * var)
        base = lgamma((nu + 1) / 2) - lgamma(nu / 2) + 0.5 * np.log(lam / (np.pi * nu))
        return base - (nu + 1) / 2 * np.log1p(lam * (np.asarray(x, float)[:, None] - mu) ** 2 / nu)

    def marginal(self, h, s):
        _, kappa, var, nu = self.posterior(h, s)
        return (
            lgamma(nu / 2) - lgamma(h["nu"] / 2) + 0.5 * np.log(h["kappa"] / kappa) + h["nu"] / 2 * np.log(h["nu"] * h["sigmasq"]) - nu / 2 * np.log(nu * var) - s["n"] / 2 * math.log(math.pi)
        )

    def sample(self, h, s, g, unit):
        """Student's t by the polar method: points of the square are drawn until they are in the circle."""
        mu, kappa, var, nu = (v[g] for v in self.posterior(h, s))
        t, todo, k = np.zeros(len(g)), np.arange(len(g)), 0
        while len(todo) and k < 200:
            u, v = 2 * unit(k)[todo] - 1, 2 * unit(k + 1)[todo] - 1
            w = u * u + v * v
            ok = (w < 1) & (w > 0)
            at = todo[ok]
            t[at] = u[ok] * np.sqrt(nu[at] * np.expm1(-2 / nu[at] * np.log(w[ok])) / w[ok])
            todo, k = todo[~ok], k + 2
        return mu + t * np.sqrt(var * (kappa + 1) / kappa)


#: The models in their canonical order.
MODELS: dict[str, Model] = {m.name: m for m in (BetaBernoulli(), DirichletDiscrete(), DirichletProcessDiscrete(), GammaPoisson(), NormalInverseChiSq())}


def partition_score(counts: np.ndarray, alpha: float, d: float) -> float:
    """Log probability of a partition with these group sizes under Pitman-Yor(alpha, d)."""
    c = np.asarray(counts, float)
    c = c[c > 0]
    n, k = int(c.sum()), len(c)
    if not n:
        return 0.0
    groups = float(np.log(alpha + d * np.arange(1, k)).sum())
    sizes = float((lgamma(c - d) - lgamma(1 - d)).sum())
    return groups + sizes - float(lgamma(alpha + n) - lgamma(alpha + 1))


def partition_scores(counts: np.ndarray, pairs) -> np.ndarray:
    """partition_score for each of many pairs (alpha, d)."""
    c = np.asarray(counts, float)
    sizes, times = np.unique(c[c > 0], return_counts=True)
    n, k = sizes @ times, int(times.sum())
    if not n:
        return np.zeros(len(pairs))
    alpha, d = np.asarray(pairs, float).T[:, :, None]
    groups = np.log(alpha + d * np.arange(1, k)).sum(axis=1)
    seats = ((lgamma(sizes - d) - lgamma(1 - d)) * times).sum(axis=1)
    return groups + seats - (lgamma(alpha + n) - lgamma(alpha + 1))[:, 0]


def partition_prior(counts: np.ndarray, alpha: float, d: float) -> np.ndarray:
    """Log prior of each group for one more row; empty groups share the mass of a new group."""
    c = np.asarray(counts, float)
    used = c > 0
    fresh = (alpha + d * used.sum()) / max(1, (~used).sum())
    return np.log(np.where(used, c - d, fresh)) - math.log(alpha + c.sum())


def stick_ends(rng: np.random.Generator, alpha: float, d: float, upto: float = 1.0) -> np.ndarray:
    """Ends of the groups' shares of a Pitman-Yor partition, laid side by side from 0 to beyond upto, or to a double's last bit below 1.

    Rows that are put to the share their own uniform number is in have the prior's partition, however many they are.
    """
    ends, left = [], 1.0
    while not ends or (ends[-1] <= upto and left > 2.0**-53):
        left *= 1 - rng.beta(1 - d, alpha + d * (len(ends) + 1))
        ends.append(1 - left)
    return np.array(ends)


def sample_partition(rng: np.random.Generator, n: int, alpha: float, d: float) -> np.ndarray:
    """Group of each of n rows, drawn from the Pitman-Yor prior; groups are numbered as they first appear."""
    if not n:
        return np.empty(0, np.int64)
    u = rng.random(n)
    ends = stick_ends(rng, alpha, d, float(u.max()))
    _, first, g = np.unique(np.minimum(np.searchsorted(ends, u, "right"), len(ends) - 1), return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[g]

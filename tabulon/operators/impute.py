"""Chained-equation imputation: each incomplete field is fitted on the others in turn, and its missing cells redrawn.

Rows are split once. The statistics of rows without a gap never change and are aggregated once; each round only visits
the rows that have gaps, so rounds cost in proportion to these. Numeric fields get a linear regression (sums of products
of the predictors, one aggregate, solved on the driver: a k x k system), and a residual drawn from its spread. Categorical
fields get a Bayes classifier over discretised predictors (counts of the classes and bins that occur together), and a class
drawn from its posterior. Draws depend on seed, round and row key alone, not on partitions or retries. Masks mark every
filled cell; cells with a usable value are never changed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.runtime import hash_unit, reliable_checkpoint


@dataclass
class Field:
    """An incomplete field: its column, `numeric` or `categorical`, its predictors, and when it's missing.

    predictors: for a numeric field, numeric expressions; for a categorical one, expressions that are cast to text bins.
    They may use the filled values of other fields by name. missing: true for a cell without a usable value.
    """

    column: str
    kind: str
    missing: Column
    predictors: list[Column]
    floor: float | None = None
    value: Column | None = None


def _normal(u1: Column, u2: Column) -> Column:
    return F.sqrt(-2 * F.log(u1)) * F.cos(2 * math.pi * u2)


def _moments(df: DataFrame, f: Field) -> np.ndarray:
    """Sums of products of (1, predictors, target) over rows whose target was observed: a (k + 2) square matrix."""
    cols = [F.lit(1.0), *[F.coalesce(p.cast("double"), F.lit(0.0)) for p in f.predictors], F.col(f.column).cast("double")]
    k = len(cols)
    row = df.where(~F.col(f"{f.column}_filled")).agg(*[F.sum(cols[i] * cols[j]) for i in range(k) for j in range(i, k)]).first()
    m = np.zeros((k, k))
    m[np.triu_indices(k)] = [v or 0.0 for v in row]
    return m + np.triu(m, 1).T


def _solve(m: np.ndarray) -> tuple[np.ndarray, float]:
    """Coefficients (slightly ridged) and residual standard deviation."""
    n = m[0, 0]
    if n < 2:
        return np.zeros(len(m) - 1), 0.0
    a, b = m[:-1, :-1], m[:-1, -1]
    beta = np.linalg.solve(a + np.diag(1e-6 * np.maximum(np.diag(a), 1e-9)), b)
    rss = max(0.0, m[-1, -1] - 2 * beta @ b + beta @ a @ beta)
    return beta, math.sqrt(rss / max(1.0, n - len(beta)))


def _tallies(df: DataFrame, f: Field) -> dict[tuple[int, str | None, str], int]:
    """Counts per (predictor, bin, class) over rows whose target was observed."""
    bins = F.array(*[F.struct(F.lit(i).alias("i"), p.cast("string").alias("b")) for i, p in enumerate(f.predictors)], F.struct(F.lit(-1).alias("i"), F.lit("").alias("b")))
    t = df.where(~F.col(f"{f.column}_filled") & F.col(f.column).isNotNull()).select(F.col(f.column).alias("c"), F.inline(bins)).groupBy("i", "b", "c").count()
    return {(r.i, r.b, r.c): r["count"] for r in t.collect()}


class Classifier:
    """Bayes classifier from counts. All classes and bins take part; only pairs of a bin and a class that were seen are kept."""

    def __init__(self, predictors: int, tallies: dict):
        counts = {c: n for (i, _, c), n in tallies.items() if i < 0}
        self.classes = sorted(counts, key=lambda c: (-counts[c], c))
        at = {c: j for j, c in enumerate(self.classes)}
        prior = 1.0 + np.array([counts[c] for c in self.classes])
        self.prior = np.log(prior / prior.sum())
        self.unseen, self.bins = [], []
        for k in range(predictors):
            own, totals = {}, np.zeros(len(self.classes))
            for (i, b, c), n in tallies.items():
                if i == k:
                    totals[at[c]] += n
                    if b is not None:
                        own.setdefault(b, []).append((at[c], n))
            # a class and a bin that never met count 0.05; what is added to this for pairs that did is kept per bin
            self.unseen.append(np.log(0.05 / (totals + 0.05 * (len(own) + 1))))
            self.bins.append({b: (np.array([j for j, _ in cs]), np.log1p(np.array([n for _, n in cs]) / 0.05)) for b, cs in own.items()})

    def draw(self, bins: pd.DataFrame, u: np.ndarray) -> np.ndarray:
        step = max(1, 4_000_000 // len(self.classes))
        return np.concatenate([self._draw(bins.iloc[i : i + step], u[i : i + step]) for i in range(0, len(u), step)] or [np.empty(0, object)])

    def _draw(self, bins: pd.DataFrame, u: np.ndarray) -> np.ndarray:
        score = np.tile(self.prior, (len(bins), 1))
        for k, known in enumerate(self.bins):
            for b, rows in bins.groupby(bins.iloc[:, k].to_numpy(object), sort=False).indices.items():
                if b in known:  # an unknown or missing predictor says nothing
                    j, more = known[b]
                    row = self.unseen[k].copy()
                    row[j] += more
                    score[rows] += row
        p = np.exp(score - score.max(axis=1, keepdims=True))
        c = np.cumsum(p, axis=1)
        return np.array(self.classes, object)[np.minimum((c < (u * c[:, -1])[:, None]).sum(axis=1), len(self.classes) - 1)]


def impute(df: DataFrame, key: str, fields: list[Field], rounds: int = 3, seed: int = 7) -> DataFrame:
    """df with the missing cells of `fields` filled, and a boolean <column>_filled for each.

    Filled numeric values are rounded to cents and not below `floor`. A field with no usable value at all stays
    null and unmarked nowhere: its cells are marked filled but null. Empty tables come back empty. Rows with equal keys
    get equal draws. Predictors that are null count as 0 (numeric) or as unknown (categorical). Other columns pass
    through; the marks replace columns of the same name.
    """
    for f in fields:
        usable = f.value if f.value is not None else F.col(f.column)
        df = df.withColumn(f"{f.column}_filled", F.coalesce(f.missing, F.lit(True))).withColumn(f.column, F.when(~F.col(f"{f.column}_filled"), usable))
    gap = F.exists(F.array(*[F.col(f"{f.column}_filled") for f in fields]), lambda x: x)
    whole = df.where(~gap)
    work = reliable_checkpoint(df.where(gap))

    fixed_moments = {f.column: _moments(whole, f) for f in fields if f.kind == "numeric"}
    fixed_tallies = {f.column: _tallies(whole, f) for f in fields if f.kind == "categorical"}

    def redraw(w: DataFrame, f: Field, turn: int) -> DataFrame:
        u = hash_unit(F.col(key), seed=seed * 1000 + turn * 17 + 1), hash_unit(F.col(key), seed=seed * 1000 + turn * 17 + 2)
        if f.kind == "numeric":
            beta, sigma = _solve(fixed_moments[f.column] + _moments(w, f))
            terms = [F.lit(float(beta[0]))] + [F.coalesce(p.cast("double"), F.lit(0.0)) * float(b) for p, b in zip(f.predictors, beta[1:])]
            new = sum(terms[1:], terms[0]) + _normal(*u) * sigma
            new = F.round(F.greatest(new, F.lit(f.floor)) if f.floor is not None else new, 2)
        else:
            tallies = dict(fixed_tallies[f.column])
            for k, n in _tallies(w, f).items():
                tallies[k] = tallies.get(k, 0) + n
            if not tallies:
                return w
            model = Classifier(len(f.predictors), tallies)

            @F.pandas_udf("string")
            def drawn(u: pd.Series, *bins: pd.Series) -> pd.Series:
                return pd.Series(model.draw(pd.concat([b.reset_index(drop=True) for b in bins], axis=1), u.to_numpy(float)))

            new = drawn(u[0], *[p.cast("string") for p in f.predictors])
        return w.withColumn(f.column, F.when(F.col(f"{f.column}_filled"), new).otherwise(F.col(f.column)))

    for turn in range(rounds):
        for f in fields:
            work = redraw(work, f, turn)
        work = reliable_checkpoint(work)
    return whole.unionByName(work)

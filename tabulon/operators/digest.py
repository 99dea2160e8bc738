"""Quantiles of very large numeric columns by merging centroid digests, with rank errors certified by a second count.

A digest of a group is a list of centroids (mean, weight) in order of value. Clusters are the cells of the scale
function k(q) = DELTA / (2 pi) * asin(2 q - 1), which is steep at both ends, so clusters in the tails are small. Digests
are built per input batch and per partition, then merged by re-clustering the union of their centroids, in two rounds
(salted by partition, then per group): no task gets more than one partition's rows or SALTS * (DELTA + 2) centroids.
Merging is associative up to the error below, so digests of single loads or days can be kept and merged later.

certify() counts, in one more pass over the values, how many lie below and at each estimate. That gives each estimate's
exact rank error; its bound by construction is 4 * pi / DELTA * sqrt(q * (1 - q)) + 2 / n for clusters that re-clustering
did not stretch, and is never assumed: what is reported is the counted error.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DELTA = 200
SALTS = 32
#: Estimates that are broadcast at most, a few MB.
BROADCAST_GROUPS = 100_000


def cluster_cells(q: np.ndarray, delta: int = DELTA) -> np.ndarray:
    return np.floor(delta / (2 * np.pi) * np.arcsin(np.clip(2 * q - 1, -1, 1)) + delta / 4).astype(np.int64)


def cluster(group: np.ndarray, mean: np.ndarray, weight: np.ndarray, low: np.ndarray, high: np.ndarray, delta: int = DELTA) -> tuple[np.ndarray, ...]:
    """Digest many groups at once: arrays of (group code, mean, weight, low, high), one row per centroid, in order."""
    order = np.lexsort((mean, group))
    group, mean, weight, low, high = group[order], mean[order], weight[order], low[order], high[order]
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[first, len(group)])
    total = np.repeat(np.add.reduceat(weight, first), sizes)
    ends = np.cumsum(weight)
    before = ends - weight - np.repeat((ends - weight)[first], sizes)
    cells = cluster_cells((before + weight / 2) / total, delta)
    at = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (cells[1:] != cells[:-1])])
    w = np.add.reduceat(weight, at)
    return group[at], np.add.reduceat(mean * weight, at) / w, w, np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)


def quantiles(mean: np.ndarray, weight: np.ndarray, low: float, high: float, ps: Sequence[float]) -> list[float]:
    """Estimates from one digest: linear between the centroids' middle ranks, exact at both ends."""
    total = weight.sum()
    middle = np.r_[0, np.cumsum(weight) - weight / 2, total]
    return [float(v) for v in np.interp(np.asarray(ps) * total, middle, np.r_[low, mean, high])]


_OUT = "centroids array<struct<mean:double,weight:bigint>>, low double, high double, n bigint"


def _pack(keys: pd.DataFrame, g: np.ndarray, m: np.ndarray, w: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pd.DataFrame:
    at = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.empty(0, int)
    ends = np.r_[at[1:], len(g)]
    out = keys.iloc[g[at]].reset_index(drop=True)
    out["centroids"] = [[{"mean": a, "weight": int(b)} for a, b in zip(m[i:j].tolist(), w[i:j].tolist())] for i, j in zip(at, ends)]
    out["low"], out["high"] = [lo[i] for i in at], [hi[j - 1] for j in ends]
    out["n"] = [int(w[i:j].sum()) for i, j in zip(at, ends)]
    return out


def digests(df: DataFrame, keys: list[str], value: str, delta: int = DELTA) -> DataFrame:
    """One digest per combination of keys: keys, centroids, low, high, n.

    Null and NaN values are left out; infinities too. A group with no usable value has no digest. Null keys are a group
    of their own. Ties and repeated rows count each. Columns beyond keys and value are ignored.
    """
    kinds = dict(df.dtypes)
    d = df.select(*keys, F.col(value).cast("double").alias("value")).where("value is not null and not isnan(value) and abs(value) < double('infinity')")
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys)

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        names: dict[tuple, int] = {}

        def squeeze() -> None:
            parts = [np.concatenate(x) for x in zip(*held)]
            held[:] = [cluster(*parts, delta=delta)]

        for b in batches:
            codes = np.zeros(len(b), np.int64)
            for k in keys:
                c, u = pd.factorize(b[k], use_na_sentinel=True)
                codes = codes * (len(u) + 1) + (c + 1)
            found, at, inverse = np.unique(codes, return_index=True, return_inverse=True)
            mine = np.array([names.setdefault(tuple(None if pd.isna(v) else v for v in row), len(names)) for row in b[keys].iloc[at].itertuples(index=False, name=None)], np.int64)
            v = b.value.to_numpy(float)
            held.append((mine[inverse], v, np.ones(len(v)), v, v))
            if sum(len(h[0]) for h in held) > 400_000:
                squeeze()
        if held:
            squeeze()
            yield _pack(pd.DataFrame(list(names), columns=keys), *held[0])

    parts = d.mapInPandas(local, f"{schema}, {_OUT}")
    return merge(parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))), [*keys, "salt"], delta, keep=keys, again=True)


def merge(parts: DataFrame, keys: list[str], delta: int = DELTA, keep: list[str] | None = None, again: bool = False) -> DataFrame:
    """Merge digests with equal keys by re-clustering their centroids; parts has what digests() returns."""
    keep = keep or keys
    kinds = dict(parts.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keep)
    near = parts.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            new = np.zeros(len(b), bool)
            for k in keys:
                code = pd.factorize(b[k])[0]  # null is -1
                new[1:] |= code[1:] != code[:-1]
            run = np.cumsum(new)
            last = run == run[-1] if len(run) else np.empty(0, bool)
            yield from combine(b[~last], run[~last])
            rest = b[last]
            if len(rest) > 64:  # a long run of one key stays small
                rest = pd.concat(list(combine(rest, np.zeros(len(rest)), full=True)), ignore_index=True)
        if rest is not None and len(rest):
            yield from combine(rest, np.zeros(len(rest)))

    def combine(b: pd.DataFrame, run: np.ndarray, full: bool = False) -> Iterator[pd.DataFrame]:
        if not len(b):
            return
        code = np.unique(run, return_inverse=True)[1]
        heads = b[keys if full else keep].iloc[np.unique(code, return_index=True)[1]].reset_index(drop=True)
        n = np.array([len(c) for c in b.centroids])
        m = np.array([c["mean"] for cs in b.centroids for c in cs])
        w = np.array([c["weight"] for cs in b.centroids for c in cs], float)
        g = np.repeat(code, n)
        # the ends of each digest travel as the low of its first and the high of its last centroid
        lo, hi = m.copy(), m.copy()
        at = np.cumsum(n) - n
        lo[at], hi[np.cumsum(n) - 1] = b.low.to_numpy(float), b.high.to_numpy(float)
        g2, m2, w2, l2, h2 = cluster(g, m, w, lo, hi, delta)
        out = _pack(heads, g2, m2, w2, l2, h2)
        edge = np.flatnonzero(np.r_[True, g2[1:] != g2[:-1]])
        out["low"], out["high"] = np.minimum.reduceat(l2, edge), np.maximum.reduceat(h2, edge)
        yield out

    merged = near.mapInPandas(join, f"{schema}, {_OUT}")
    return merge(merged, keep, delta) if again else merged


def estimate(merged: DataFrame, ps: Sequence[float]) -> DataFrame:
    """Quantile estimates: the keys, n, p and estimate, one row per digest and p."""
    ps = [float(p) for p in ps]

    @F.pandas_udf("array<struct<p:double,estimate:double>>")
    def read(centroids: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
        return pd.Series([[{"p": p, "estimate": v} for p, v in zip(ps, quantiles(np.array([c["mean"] for c in cs]), np.array([float(c["weight"]) for c in cs]), lo, hi, ps))] for cs, lo, hi in zip(centroids, low, high)])

    keys = [c for c in merged.columns if c not in ("centroids", "low", "high", "n")]
    return merged.select(*keys, "n", F.inline(read("centroids", "low", "high")))


def certify(df: DataFrame, keys: list[str], value: str, estimates: DataFrame) -> DataFrame:
    """Add the exact rank error of each estimate: below, equal (counts) and rank_error.

    rank_error is 0 if the wanted rank p * n lies between the number of values below the estimate and that of values
    not above it, else the distance to the nearer of the two, as a share of n. estimates is what estimate() returns.
    The estimates of a group are one array. Up to BROADCAST_GROUPS estimates (they are counted first) go to the rows; beyond,
    groups are joined in SALTS parts each, so that a group with a third of all rows is spread either way.
    """
    kept = df.select(*keys, F.col(value).cast("double").alias("value")).where("value is not null and not isnan(value) and abs(value) < double('infinity')")
    lists = estimates.groupBy(*keys).agg(F.sort_array(F.collect_set("estimate")).alias("cuts"))
    # Values are first counted by the cell of cuts they fall in: 2 * len(cuts) + 1 counters per group survive the map side.
    lists = lists.select(*[F.col(k).alias(f"__{k}") for k in keys], "cuts")
    same = lambda: [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    if estimates.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        joined = kept.join(F.broadcast(lists), same())
    else:
        part = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
        lists = lists.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = kept.withColumn("__salt", part).join(lists, [*same(), F.col("__salt") == F.col("__part")])
    placed = joined.select(*keys, F.aggregate("cuts", F.lit(0), lambda a, c: a + F.when(F.col("value") > c, 2).when(F.col("value") == c, 1).otherwise(0)).alias("cell"), "cuts")
    counts = placed.groupBy(*keys, "cell").agg(F.count(F.lit(1)).alias("m"), F.first("cuts").alias("cuts"))
    cells = counts.groupBy(*keys).agg(F.collect_list(F.struct("cell", "m")).alias("cells"), F.first("cuts").alias("cuts"))
    zero = F.lit(0).cast("bigint")
    each = cells.select(*keys, "cells", F.posexplode("cuts").alias("i", "estimate")).select(
        *[F.col(k).alias(f"__{k}") for k in keys], F.col("estimate").alias("__estimate"),
        F.aggregate("cells", zero, lambda a, c: a + F.when(c["cell"] < 2 * F.col("i") + 1, c["m"]).otherwise(zero)).alias("below"),
        F.aggregate("cells", zero, lambda a, c: a + F.when(c["cell"] == 2 * F.col("i") + 1, c["m"]).otherwise(zero)).alias("equal"),
    )
    wanted = F.col("p") * F.col("n")
    error = F.greatest(F.lit(0.0), F.col("below") - wanted, wanted - F.col("below") - F.col("equal")) / F.col("n")
    return estimates.join(each, [*same(), F.col("estimate") == F.col("__estimate")]).select(*keys, "n", "p", "estimate", "below", "equal", error.alias("rank_error"))


def rank_error_bound(p: float, n: int, delta: int = DELTA) -> float:
    """The bound that estimates are held to: two clusters' width at p, and two values."""
    return 4 * np.pi / delta * float(np.sqrt(p * (1 - p))) + 2 / max(n, 1) + 1e-9

"""Sufficient statistics and marginal likelihoods by group, as plain aggregations (partial on the map side)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.special import lgamma as np_lgamma


@F.pandas_udf(T.DoubleType())
def lgamma(x: pd.Series) -> pd.Series:
    """log Gamma of positive numbers; null stays null."""
    v = x.to_numpy(float)
    return pd.Series(np_lgamma(pd.Series(v).fillna(1.0).to_numpy())).where(x.notna())


def bb_stats(df: DataFrame, keys: list[str], c: Column) -> DataFrame:
    return df.where(c.isNotNull()).groupBy(*keys).agg(F.sum(c.cast("bigint")).alias("heads"), F.sum((~c).cast("bigint")).alias("tails"))


def dd_stats(df: DataFrame, keys: list[str], c: Column) -> DataFrame:
    """Counts per value: one row per group and value."""
    return df.where(c.isNotNull()).select(*keys, c.alias("value")).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))


def gp_stats(df: DataFrame, keys: list[str], c: Column) -> DataFrame:
    """n, total and the log of the product of factorials; lgamma is taken once per distinct value."""
    v = df.where(c.isNotNull()).select(*keys, c.cast("bigint").alias("value")).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("k"))
    v = v.withColumn("lg", lgamma(F.col("value").cast("double") + 1))
    return v.groupBy(*keys).agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("value")).alias("total"), F.sum(F.col("k") * F.col("lg")).alias("log_prod"))


def nich_stats(df: DataFrame, keys: list[str], c: Column) -> DataFrame:
    return df.where(c.isNotNull()).groupBy(*keys).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), (F.var_pop(c) * F.count(c)).alias("m2"))


Number = float | Column


def _column(x: Number) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def bb_marginal(alpha: Number, beta: Number) -> Column:
    h, t, alpha, beta = F.col("heads").cast("double"), F.col("tails").cast("double"), _column(alpha), _column(beta)
    return lgamma(h + alpha) + lgamma(t + beta) - lgamma(h + t + alpha + beta) + lgamma(alpha + beta) - lgamma(alpha) - lgamma(beta)


def gp_marginal(alpha: Number, inv_beta: Number) -> Column:
    alpha, inv_beta = _column(alpha), _column(inv_beta)
    a, b = F.col("total") + alpha, F.col("n") + inv_beta
    return lgamma(a) - lgamma(alpha) + alpha * F.log(inv_beta) - a * F.log(b) - F.col("log_prod")


def nich_marginal(mu: Number, kappa: Number, sigmasq: Number, nu: Number) -> Column:
    n, mu, kappa, sigmasq, nu = F.col("n").cast("double"), _column(mu), _column(kappa), _column(sigmasq), _column(nu)
    kn, vn = n + kappa, n + nu
    var = (nu * sigmasq + F.col("m2") + n * kappa * F.pow(F.col("mean") - mu, 2) / kn) / vn
    return lgamma(vn / 2) - lgamma(nu / 2) + 0.5 * F.log(kappa / kn) + nu / 2 * F.log(nu * sigmasq) - vn / 2 * F.log(vn * var) - n / 2 * math.log(math.pi)


def dd_marginal(counts: DataFrame, keys: list[str], alpha: float, values: int) -> DataFrame:
    """keys and log_marginal from dd_stats() rows, for a symmetric prior over so many values."""
    t = counts.withColumn("t", lgamma(F.col("n") + F.lit(alpha)) - math.lgamma(alpha))
    g = t.groupBy(*keys).agg(F.sum("n").cast("double").alias("total"), F.sum("t").alias("t"))
    a = alpha * values
    return g.select(*keys, (math.lgamma(a) - lgamma(F.col("total") + a) + F.col("t")).alias("log_marginal"))


def partition_scores(sizes: DataFrame, keys: list[str], grid: DataFrame) -> DataFrame:
    """Log probability of each key's partition under every (alpha, d) of a grid: keys, alpha, d, score.

    sizes: keys, size (one row per non-empty group). The grid has a fixed number of rows; the work per key is on its
    group sizes, of which equal ones are counted first.
    """
    s = sizes.where("size > 0").groupBy(*keys, "size").agg(F.count(F.lit(1)).alias("k"))
    x = s.crossJoin(F.broadcast(grid))
    x = x.withColumn("t", F.col("k") * (lgamma(F.col("size") - F.col("d")) - lgamma(1 - F.col("d"))))
    g = x.groupBy(*keys, "alpha", "d").agg(F.sum(F.col("k") * F.col("size")).cast("double").alias("n"), F.sum("k").alias("groups"), F.sum("t").alias("t"))
    seats = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("groups") - 1, F.lit(1))), F.lit(0.0), lambda a, i: a + F.when(i < F.col("groups"), F.log(F.col("alpha") + F.col("d") * i)).otherwise(0.0))
    return g.select(*keys, "alpha", "d", (seats + F.col("t") - lgamma(F.col("alpha") + F.col("n")) + lgamma(F.col("alpha") + 1)).alias("score"))


def log_sum_exp(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """keys and lse. Numbers are summed as multiples of exp(500 k), k being the number's own place on that scale, with partial sums on the
    map side; a key's few sums are then put together from the largest on. A null or -infinity adds nothing; without any other number lse is null.
    """
    at = F.floor(F.col(x) / 500)
    some = df.where(F.col(x).isNotNull() & (F.col(x) > -math.inf))
    parts = some.groupBy(*keys, at.alias("__at")).agg(F.sum(F.exp(F.col(x) - at * 500)).alias("__s")).withColumn("__l", F.col("__at") * 500 + F.log("__s"))
    few = parts.groupBy(*keys).agg(F.max("__l").alias("__m"), F.collect_list("__l").alias("__ls"))  # one per 500 units of the numbers' range
    return df.select(*keys).distinct().join(few, keys, "left").select(*keys, (F.col("__m") + F.log(F.aggregate("__ls", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("__m"))))).alias("lse"))


def dpd_marginal(counts: DataFrame, keys: list[str], alpha: Column, beta: Column) -> DataFrame:
    """keys and log_marginal from dd_stats() rows, for a Dirichlet process of strength alpha with base weights beta (columns of counts)."""
    t = counts.withColumn("__a", alpha).withColumn("__w", alpha * beta)
    t = t.withColumn("__t", lgamma(F.col("n") + F.col("__w")) - lgamma(F.col("__w")))
    g = t.groupBy(*keys).agg(F.sum("n").cast("double").alias("__n"), F.sum("__t").alias("__t"), F.max("__a").alias("__a"))
    return g.select(*keys, (lgamma(F.col("__a")) - lgamma(F.col("__a") + F.col("__n")) + F.col("__t")).alias("log_marginal"))


def grid_scores(stats: DataFrame, points: DataFrame, marginal: Column) -> DataFrame:
    """The points of a hyperparameter grid (a small table) with score: the sum of the groups' log marginal likelihoods there.

    marginal is an expression over the columns of both. Statistics have a row per group, so their product with the grid is small.
    """
    return stats.crossJoin(F.broadcast(points)).withColumn("__m", marginal).groupBy(*points.columns).agg(F.sum("__m").alias("score"))

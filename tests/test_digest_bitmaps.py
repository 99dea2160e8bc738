import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.operators import bitmaps, digest


def values(spark, rows):
    return spark.createDataFrame(rows, "g string, day int, v double")


@pytest.mark.parametrize("limit", [digest.BROADCAST_GROUPS, 0])
def test_estimates_are_within_their_bound_and_counted_exactly(spark, monkeypatch, limit):
    monkeypatch.setattr(digest, "BROADCAST_GROUPS", limit)
    rng = np.random.default_rng(0)
    data = {"a": rng.normal(0, 1, 6000), "b": rng.integers(0, 5, 2000).astype(float), "c": rng.pareto(1, 500), "one": np.array([7.0])}
    rows = [(g, int(i % 7), float(v)) for g, vs in data.items() for i, v in enumerate(vs)] + [("a", 0, None), ("a", 0, float("nan")), ("a", 1, float("inf")), (None, 1, 5.0), ("void", 1, None)]
    df = values(spark, rows).repartition(6).withColumn("n", F.lit("clash"))
    ps = (0.01, 0.25, 0.5, 0.9, 1.0)
    merged = digest.merge(digest.digests(df, ["g", "day"], "v"), ["g"])
    got = digest.certify(df, ["g"], "v", digest.estimate(merged, ps)).collect()
    assert len(got) == 5 * len(ps)
    for r in got:
        v = data.get(r.g, np.array([5.0]))
        assert r.n == len(v)
        assert r.below == (v < r.estimate).sum() and r.equal == (v == r.estimate).sum()
        assert r.rank_error <= digest.rank_error_bound(r.p, r.n)


def test_merging_days_equals_one_digest_within_the_bound(spark):
    rng = np.random.default_rng(1)
    rows = [("a", i % 5, float(v)) for i, v in enumerate(rng.exponential(1, 4000))]
    df = values(spark, rows)
    both = [{r.p: r.estimate for r in digest.estimate(d, (0.1, 0.5, 0.9)).collect()} for d in (digest.digests(df, ["g"], "v"), digest.merge(digest.digests(df, ["g", "day"], "v"), ["g"]))]
    for p in (0.1, 0.5, 0.9):
        assert abs(both[0][p] - both[1][p]) < 0.1


def test_digest_of_ties_extremes_and_nothing(spark):
    df = values(spark, [("t", 0, 3.0)] * 1000)
    assert {r.estimate for r in digest.estimate(digest.digests(df, ["g"], "v"), (0.0, 0.5, 1.0)).collect()} == {3.0}
    assert digest.digests(values(spark, []), ["g"], "v").count() == 0


def test_cluster_sizes_follow_the_scale_function():
    v = np.sort(np.random.default_rng(0).random(10_000))
    _, _, w, _, _ = digest.cluster(np.zeros(len(v), int), v, np.ones(len(v)), v, v)
    assert w[0] < 10 and w[-1] < 10 and 50 < w.max() < 200 and len(w) <= digest.DELTA + 2


def test_distinct_counts_within_error_and_mergeable(spark):
    rows = [(i % 3, f"id{i % 900}") for i in range(5000)] + [(0, None), (None, "id1")]
    df = spark.createDataFrame(rows, "day int, id string").withColumn("bit", F.lit("clash"))
    bits = bitmaps.size_bits(10_000, 0.01)
    part = bitmaps.bitmaps(df, ["day"], F.col("id"), bits)
    exact = {r.day: r.n for r in df.where("id is not null").groupBy("day").agg(F.count_distinct("id").alias("n")).collect()}
    for r in bitmaps.estimates(part, ["day"]).collect():
        assert abs(r.estimate - exact[r.day]) <= max(3, r.error_bound * exact[r.day])
    total = bitmaps.estimates(bitmaps.union(part.withColumn("every", F.lit(1)), ["every"]), ["every"]).first()
    assert abs(total.estimate - 900) <= max(3, total.error_bound * 900)


def test_bitmaps_of_many_values_and_of_none(spark):
    df = spark.range(60_000).select(F.lit(1).alias("g"), F.col("id").cast("string").alias("id"))
    bits = 4 * bitmaps.LEAST_BITS
    m = bitmaps.bitmaps(df, ["g"], F.col("id"), bits)
    assert m.count() == bits // bitmaps.PAGE
    r = bitmaps.estimates(m, ["g"]).first()
    assert abs(r.estimate - 60_000) < 3 * bitmaps.standard_error(60_000, bits) * 60_000
    assert bitmaps.bitmaps(df.where("false"), ["g"], F.col("id"), bits).count() == 0
    full = bitmaps.estimates(bitmaps.bitmaps(df, ["g"], F.col("id"), bitmaps.PAGE), ["g"]).first()
    assert full.bits_set == bitmaps.PAGE and full.error_bound is None


def test_bitmaps_of_different_sizes_are_folded(spark):
    ids = spark.range(3000).select(F.lit(None).cast("int").alias("g"), F.col("id").cast("string").alias("id"))
    small, large = (bitmaps.bitmaps(ids.where(c), ["g"], F.col("id"), b) for c, b in (("id < 2000", 1 << 15), ("id >= 1000", 1 << 17)))
    got = bitmaps.union(small.unionByName(large), ["g"])
    want = bitmaps.bitmaps(ids, ["g"], F.col("id"), 1 << 15)
    assert sorted(got.collect()) == sorted(want.collect())
    with pytest.raises(ValueError):
        bitmaps.bitmaps(ids, ["g"], F.col("id"), 1000)


def test_sizing_meets_its_target():
    for n in (1000, 10**6, 10**8):
        assert bitmaps.standard_error(n, bitmaps.size_bits(n, 0.01)) <= 0.01

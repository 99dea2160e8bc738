import pytest
from pyspark.sql import functions as F

from tabulon.llm import mixing

SIZES = "doc_id bigint, source string, size bigint"
TARGETS = "source string, weight double, max_repeats int"


def corpus(spark, counts, sizes=(10, 20, 35)):
    rows, i = [], 0
    for s, n in counts.items():
        for _ in range(n):
            rows.append((i, s, sizes[i % len(sizes)]))
            i += 1
    return spark.createDataFrame(rows, SIZES)


def test_shares_reach_their_targets_within_a_document(spark):
    d = corpus(spark, {"big": 3000, "mid": 500, "small": 60})
    t = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 4), ("none", 0.1, 3), ("off", None, None)], TARGETS)
    m = mixing.mix(d, t)
    for r in mixing.shares(m, d, t).collect():
        assert r.most_copies <= r.max_repeats
        if r.source == "none":
            assert r.tokens == 0 and r.docs == 0
        else:
            assert r.actual_share == pytest.approx(r.weight, abs=0.01)
    assert m.where("source = 'small'").agg(F.min("copies")).first()[0] == 4
    assert m.count() == m.select("doc_id").distinct().count()


def test_copies_are_whole_ones_and_at_most_one_more(spark):
    d = corpus(spark, {"a": 400, "b": 1000})
    t = spark.createDataFrame([("a", 0.5, 5), ("b", 0.5, 1)], TARGETS)
    c = {r.copies: r["count"] for r in mixing.mix(d, t).where("source = 'a'").groupBy("copies").count().collect()}
    assert set(c) == {2, 3} and sum(c.values()) == 400


def test_a_wanted_total_is_met(spark):
    d = corpus(spark, {"a": 2000, "b": 2000})
    t = spark.createDataFrame([("a", 0.25, 1), ("b", 0.75, 1)], TARGETS)
    got = {r.source: r.n for r in mixing.mix(d, t, total=20_000).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("n")).collect()}
    assert got["a"] == pytest.approx(5000, abs=40) and got["b"] == pytest.approx(15_000, abs=40)


def test_draws_ignore_partitioning_and_follow_the_seed(spark):
    d = corpus(spark, {"a": 900, "b": 100})
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], TARGETS)
    ids = lambda x, **k: {r.doc_id for r in mixing.mix(x, t, **k).collect()}
    assert ids(d) == ids(d.repartition(7)) != ids(d, seed=6)


def test_favoured_documents_are_taken_more_often(spark):
    d = corpus(spark, {"a": 4000, "b": 200}, sizes=(10,)).withColumn("q", F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0))
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], TARGETS)
    n = {r.even: r["count"] for r in mixing.mix(d, t, favour="q").where("source = 'a'").groupBy((F.col("doc_id") % 2 == 0).alias("even")).count().collect()}
    assert 2 < n[True] / n[False] < 5 and n[True] + n[False] == pytest.approx(200, abs=2)


def test_names_odd_rows_and_empty_tables(spark):
    names = spark.createDataFrame([(" MT-Gateway ",), ("mt gateway",), ("",), (None,)], "s string").select(mixing.source_name("s").alias("n")).collect()
    assert [r.n for r in names] == ["mt_gateway", "mt_gateway", None, None]
    d = spark.createDataFrame([(1, "a", 10), (1, "a", 10), (2, "a", 0), (None, "a", 5), (3, None, 10), (4, "z", 10)], SIZES).withColumn("part", F.lit("clash")).withColumn("rest", F.lit(1))
    t = spark.createDataFrame([("A", 0.5, 1), ("a ", 0.5, 2), (None, 1.0, 1), ("q", float("nan"), 1)], TARGETS)
    assert sorted(str(r.doc_id) for r in mixing.mix(d, t).collect()) == ["1", "1", "None"]
    assert mixing.mix(d.where("false"), t).count() == 0
    assert mixing.mix(d, t.where("false")).count() == 0
    assert mixing.shares(mixing.mix(d.where("false"), t), d.where("false"), t).first().actual_share is None

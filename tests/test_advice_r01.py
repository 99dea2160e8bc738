import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.functions import crosscat as cc
from tabulon.functions.models import sample_partition
from tabulon.operators import ensemble, impute, profile
from tabulon.plans import problems, survey
from tabulon.plans.schema import Feature
from tabulon.streaming import single_pass
from tabulon.table import PredictiveTable


class Asked(Exception):
    pass


@pytest.mark.parametrize("name", ["infer", "mix", "score", "predict", "relate", "refine", "support", "search", "similar", "group", "cluster", "crossvalidate", "density_image", "generate", "infer_single_pass"])
def test_engine_queries_learn_with_the_defaults(spark, data, monkeypatch, name):
    def fit(spark, source, **options):
        raise Asked(options)

    monkeypatch.setattr(PredictiveTable, "fit", fit)
    with pytest.raises(Asked) as e:
        getattr(survey, name)(spark, data)
    options = e.value.args[0]
    assert "learn_rows" not in options
    assert "config" not in options or name == "infer_single_pass"


@pytest.mark.parametrize("name", ["relate", "refine", "support"])
def test_engine_queries_ask_with_the_default_count(spark, data, monkeypatch, name):
    class Table:
        def __getattr__(self, method):
            def call(*args, **options):
                raise Asked(options)

            return call

    monkeypatch.setattr(survey, "learnt", lambda s, d: Table())
    with pytest.raises(Asked) as e:
        getattr(survey, name)(spark, data)
    assert "count" not in e.value.args[0]


def test_the_schedule_drives_learning(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(ensemble, "extra_passes", lambda rows: asked.append(rows) or 1.0)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(np.random.default_rng(0).normal(size=20))], "row_id bigint, x double")
    PredictiveTable.fit(spark, df, models={"x": "nich"}, samples=1)
    assert asked == [20]


def test_auxiliary_kinds_are_prior_draws_at_every_size(monkeypatch):
    rng, n = np.random.default_rng(0), 6000
    asked = []
    monkeypatch.setattr(cc, "sample_partition", lambda rng, n, *prior: asked.append(n) or sample_partition(rng, n, *prior))
    c = cc.Chain({"x": "nich", "y": "nich"}, {f: (rng.normal(size=n), np.ones(n, bool)) for f in "xy"}, n, 1)
    c.assign = [np.zeros(n, np.int64) for _ in c.assign]
    c.kind_step()
    assert asked == [n]


def test_large_prior_draws_have_the_prior_s_pairs():
    rng = np.random.default_rng(1)
    draws = [sample_partition(rng, 6000, 2.0, 0.1) for _ in range(800)]
    assert np.mean([g[0] == g[-1] for g in draws]) == pytest.approx(0.9 / 3, abs=0.06)
    assert np.std([g.max() for g in draws]) > 2


def test_a_kind_with_400_groups_opens_one_more():
    n = 401
    c = cc.Chain({"x": "nich"}, {"x": (np.arange(n) * 1e3, np.ones(n, bool))}, n, 0)
    kind = c.sample.kinds[0]
    kind.counts = np.zeros(400)
    kind.stats = {"x": cc.MODELS["nich"].empty(c.sample.hypers["x"], 400)}
    for i in range(400):
        c.put(0, i, i, 1)
    c.sample.rows = 400
    c.add(400)
    assert len(kind.counts) == 401


def test_clusters_that_the_first_rows_miss_get_groups_of_their_own(spark):
    codes = [0] * 1500 + [1 + k for k in range(3) for _ in range(40)]
    df = spark.createDataFrame([(i, c, c, c) for i, c in enumerate(codes)], "row_id bigint, a int, b int, c int")
    features = [Feature(f, "dd", {str(k): k for k in range(4)}) for f in "abc"]
    s = ensemble.learn(df, features, 1, cc.Config(extra_passes=9.0), learn_rows=20)[0]
    assert all(k.counts.sum() == len(codes) for k in s.kinds)
    assert len(s.kinds) == 1 and len(s.kinds[0].features) == 3  # which so few rows hardly show
    n = s.kinds[0].stats["a"]["counts"]
    assert [k for k in range(4) if (n[:, k] > 0.9 * np.maximum(n.sum(axis=1), 1)).any()] == list(range(4))


def test_a_stream_counts_every_order_once(spark, data):
    lines = [r.line for r in survey.stream_single_pass(spark, data).collect()]
    n = spark.read.parquet(f"{data}/orders.parquet").count()
    assert f" {n} rows" in lines[-1]


def test_a_batch_opens_the_groups_it_needs(spark, tmp_path):
    batch = lambda codes: spark.createDataFrame([(i, c, c, c) for i, c in enumerate(codes)], "row_id bigint, a int, b int, c int")
    features = [Feature(f, "dd", {str(k): k for k in range(6)}) for f in "abc"]
    learner = single_pass.StreamLearner(spark, lambda first: ensemble.single_pass(first, features), str(tmp_path))
    learner(batch([0] * 100), 0)
    before = [(k.counts > 0).sum() for k in learner.samples[0].kinds]
    learner(batch([1 + i % 5 for i in range(500)]), 1)
    assert learner.samples[0].rows == 600
    assert any((k.counts > 0).sum() > b + 1 for k, b in zip(learner.samples[0].kinds, before))


def filled(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, c string, p string, x double")
    fields = [impute.Field("c", "categorical", F.col("c").isNull(), [F.col("p")]), impute.Field("x", "numeric", F.col("x").isNull(), [F.lit(1.0)])]
    return {r.id: r.c for r in impute.impute(df, "id", fields, rounds=1).where("c_filled").collect()}


def test_classes_of_rows_that_lack_another_field_are_drawn(spark):
    got = filled(spark, [(i, "b", "q", None) for i in range(50)] + [(100 + i, None, "q", 1.0) for i in range(5)])
    assert got == {100 + i: "b" for i in range(5)}


def test_rare_bins_tell_what_they_know(spark):
    rows = [(i, "ab"[i % 4200 % 2], f"p{i % 4200:05d}", 1.0) for i in range(8200)] + [(10_000 + i, None, f"p{i:05d}", 1.0) for i in range(4000, 4200)]
    got = filled(spark, rows)
    assert np.mean([got[10_000 + i] == "ab"[i % 2] for i in range(4000, 4200)]) > 0.8


def test_free_values_of_one_load_hide_no_other_load(spark):
    rng = np.random.default_rng(0)
    rows = []
    for k in range(9):
        for i in range(400):
            code = rng.choice(["1", "2"], p=[0.9, 0.1])
            rows.append((f"L{k}", str(100 + i) if k == 4 else {"1": "2", "2": "1"}[code] if k == 6 else code))
    df = spark.createDataFrame(rows, "load string, code string")
    for parts in (1, 16):
        got = {(r.load, r.column_name) for r in profile.changed_loads(profile.forms(df.repartition(parts), "load")).collect()}
        assert got == {("L4", "code"), ("L6", "code")}


def test_whole_results_are_registered_first():
    names = list(problems.queries())
    assert [next(n for n in names if n.startswith(p)) for p in ("p4_", "p5_")] == ["p4_percentiles", "p5_load_bitmaps"]


def test_profiles_do_not_depend_on_the_layout(spark, data):
    e = spark.read.parquet(f"{data}/example.parquet")
    key = lambda r: tuple(map(str, r))
    one, many = (profile.forms(e.repartition(n), "load_id") for n in (1, 40))
    assert sorted(one.collect(), key=key) == sorted(many.collect(), key=key)
    assert sorted(profile.changed_loads(one).select("load", "column_name").collect()) == sorted(profile.changed_loads(many).select("load", "column_name").collect())

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.functions import crosscat as cc
from tabulon.functions.models import MODELS
from tabulon.functions.special import deal
from tabulon.operators import ensemble
from tabulon.plans import survey
from tabulon.plans.encode import encode
from tabulon.plans.schema import Feature
from tabulon.table import PredictiveTable

KINDS = {"a": "dd", "b": "bb", "c": "gp", "x": "nich"}


def repeated(spark, n=4000):
    """Rows of few combinations of values, with gaps, NaN and both zeros."""
    x = F.when(F.col("id") % 7 == 0, F.lit(None).cast("double")).when(F.col("id") % 7 == 1, F.lit(float("nan"))).when(F.col("id") % 7 == 2, F.lit(-0.0)).when(F.col("id") % 7 == 3, F.lit(0.0)).otherwise(F.lit(2.5))
    return spark.range(n).select(F.col("id").alias("row_id"), (F.col("id") % 3).cast("int").alias("a"), F.when(F.col("id") % 5 > 0, F.col("id") % 5 > 2).alias("b"), F.when(F.col("id") % 2 == 0, F.col("id") % 4 + 3).alias("c"), x.alias("x"))


def sample(spark, n=4000, groups=3):
    """A sample with two kinds of so many groups."""
    rng, hypers = np.random.default_rng(0), {"a": {"alphas": np.full(3, 0.5)}, "b": {"alpha": 0.5, "beta": 0.5}, "c": {"alpha": 1.0, "inv_beta": 1.0}, "x": {"mu": 1.0, "kappa": 0.1, "sigmasq": 1.0, "nu": 1.0}}
    kinds = []
    for fs in (["a", "b"], ["c", "x"]):
        stats = {f: MODELS[KINDS[f]].empty(hypers[f], groups) for f in fs}
        for f in fs:
            for g in range(groups):
                for v in rng.integers(0, 2, 20):
                    MODELS[KINDS[f]].add(hypers[f], stats[f], g, v)
        kinds.append(cc.Kind(fs, 2.0, 0.1, np.full(groups, 20.0), stats))
    return cc.Sample(KINDS, hypers, kinds, rows=20 * groups).with_empty()


# -- F1: crossvalidate ---------------------------------------------------------------------------------------------
def test_crossvalidate_learns_only_the_shares(spark, data, monkeypatch):
    sizes, scored = [], []

    def learn(df, features, *args, **options):
        sizes.append(df.count())
        return []

    monkeypatch.setattr(ensemble, "learn", learn)
    monkeypatch.setattr(ensemble, "score", lambda df, samples, keep=(): scored.append(df.count()) or df.withColumn("score", F.lit(0.0)))
    monkeypatch.setattr(survey, "_LEARNT", {})
    n = spark.read.parquet(f"{data}/lineitem.parquet").count()
    got = survey.crossvalidate(spark, data).orderBy("seed").collect()
    assert sizes == [int(0.9 * n)] * 2 and scored == [n - int(0.9 * n)] * 2
    assert [(r.seed, r.rows) for r in got] == [(0, n - int(0.9 * n)), (1, n - int(0.9 * n))]


def test_equal_rows_are_kept_once_with_their_number(spark):
    df = repeated(spark)
    with ensemble.packed(df, KINDS) as packs:
        got = [(counts, columns) for _, counts, _, columns, _ in ensemble.unpacked(iter([packs.table.toPandas()]))]
        assert (packs.rows, packs.whole) == (4000, {"a"})
    assert sum(c.sum() for c, _ in got) == 4000
    assert sum(len(c) for c, _ in got) <= 3 * 3 * 3 * 3  # values of a, b, c and x, gaps among them
    for f in KINDS:
        v = df.select(f).where(f"{f} is not null" + (" and not isnan(x)" if f == "x" else "")).agg(F.count(f), F.sum(F.col(f).cast("double"))).first()
        assert sum(c[cols[f][1]].sum() for c, cols in got) == v[0]
        assert sum((c * cols[f][0] * cols[f][1]).sum() for c, cols in got) == pytest.approx(v[1])


@pytest.mark.parametrize("groups", [3, 40])
def test_a_pass_over_equal_rows_sums_every_row_under_any_layout(spark, groups):
    df, s = repeated(spark), sample(spark, groups=groups)
    one, many = (ensemble.gibbs_pass(df.repartition(n), [s], 5, renumber=False)[0] for n in (1, 9))
    for k, kind in enumerate(one.kinds):
        assert kind.counts.sum() == 4000 and (kind.counts == many.kinds[k].counts).all()
        for f in kind.features:
            for name, v in kind.stats[f].items():
                assert v == pytest.approx(many.kinds[k].stats[f][name])
    seen = df.agg(F.count("a"), F.count("b"), F.sum("c"), F.count(F.when(~F.isnan("x"), F.col("x"))), F.sum(F.when(~F.isnan("x"), F.col("x")))).first()
    a, b, c, x = (one.kinds[one.kind_of(f)].stats[f] for f in "abcx")
    assert a["counts"].sum() == seen[0] and b["heads"].sum() + b["tails"].sum() == seen[1] and c["total"].sum() == seen[2]
    assert x["n"].sum() == seen[3] and (x["n"] * x["mean"]).sum() == pytest.approx(seen[4])


@pytest.mark.parametrize("count", [2, 5000])
def test_dealt_rows_follow_the_scores(count):
    scores = np.log(np.array([[0.7, 0.2, 0.1], [0.05, 0.05, 0.9]]))
    code = np.tile([0, 1, 1], 1000 if count == 2 else 20)
    i, g, w = deal(np.random.default_rng(1), scores, code, np.full(len(code), count))
    assert (np.bincount(i, w, len(code)) == count).all()
    for j in (0, 1):
        share = np.bincount(g[code[i] == j], w[code[i] == j], 3)
        assert share / share.sum() == pytest.approx(np.exp(scores[j]), abs=0.03)


def test_dealt_rows_spread_as_single_draws_do():
    n = [np.bincount(g, w, 2)[0] for g, w in (deal(np.random.default_rng(s), np.log([[0.3, 0.7]]), np.zeros(1, np.int64), np.array([100]))[1:] for s in range(2000))]
    assert np.mean(n) == pytest.approx(30, abs=0.5) and np.var(n) == pytest.approx(21, rel=0.15)


@pytest.mark.parametrize("model", list(MODELS))
def test_weights_count_as_rows(model):
    rng, m = np.random.default_rng(0), MODELS[model]
    x, g, w = rng.integers(0, 2, 50), rng.integers(0, 4, 50), rng.integers(1, 5, 50)
    h = m.default(x) if model != "bb" else m.default(x.astype(bool))
    x = x.astype(bool) if model == "bb" else x
    each, all_ = m.from_rows(h, x, g, 4, w), m.from_rows(h, np.repeat(x, w), np.repeat(g, w), 4)
    assert all(each[f] == pytest.approx(all_[f]) for f in all_)


def test_samples_learn_the_same_from_any_layout(spark):
    df = repeated(spark, 2000).select("row_id", "a", "c")
    features = [Feature("a", "dd", {str(i): i for i in range(3)}), Feature("c", "gp")]
    one, many = (ensemble.learn(df.repartition(n), features, 2, cc.Config(extra_passes=1.0), learn_rows=300) for n in (1, 6))
    assert [s.log_likelihood() for s in one] == pytest.approx([s.log_likelihood() for s in many])
    assert all(k.counts.sum() == 2000 for s in one for k in s.kinds)


def test_rows_are_scored_once_for_equal_values(monkeypatch, spark):
    s, n, scored = sample(spark), 6000, []
    plain = cc.Sample.group_scores
    monkeypatch.setattr(cc.Sample, "group_scores", lambda self, k, columns, n, only=None: scored.append(n) or plain(self, k, columns, n, only))
    rng, seen = np.random.default_rng(0), np.random.default_rng(1).random(n) < 0.7
    columns = {"a": (rng.integers(0, 3, n), np.ones(n, bool)), "b": (rng.random(n) < 0.5, seen), "c": (rng.integers(0, 9, n), seen), "x": (rng.integers(0, 4, n) / 2.0, np.ones(n, bool))}
    got = cc.ensemble_score([s, s], columns, n)
    assert sum(scored) < 400
    whole = sum(np.logaddexp.reduce(plain(s, k, columns, n), axis=1) for k in range(2))
    assert got == pytest.approx(whole)


# -- F2: predict ---------------------------------------------------------------------------------------------------
def test_only_gaps_are_drawn_and_equal_rows_are_scored_once(monkeypatch, spark):
    s, n, scored, drawn = sample(spark), 6000, [], []
    plain, gp = cc.Sample.group_scores, MODELS["gp"].sample
    monkeypatch.setattr(cc.Sample, "group_scores", lambda self, k, columns, n, only=None: scored.append(n) or plain(self, k, columns, n, only))
    monkeypatch.setattr(MODELS["gp"], "sample", lambda h, st, g, unit: drawn.append(len(g)) or gp(h, st, g, unit))
    rng, seen = np.random.default_rng(0), np.random.default_rng(1).random(n) < 0.75
    columns = {"a": (rng.integers(0, 3, n), np.ones(n, bool)), "b": (rng.random(n) < 0.5, np.ones(n, bool)), "c": (np.where(seen, rng.integers(0, 9, n), 0), seen), "x": (rng.integers(0, 4, n) / 2.0, np.ones(n, bool))}
    got = cc.draw([s, s], columns, n, ["a", "c"], 2, np.arange(n), 3, gaps=True)
    assert sum(scored) < 400 and sum(drawn) == 2 * (~seen).sum()
    assert not got["c"][seen].any() and not got["a"].any()
    whole = cc.draw([s, s], columns, n, ["a", "c"], 2, np.arange(n), 3)
    assert (got["c"][~seen] == whole["c"][~seen]).all()


def test_predicted_rows_keep_what_is_observed_under_any_layout(spark):
    df, s = repeated(spark).withColumn("x", F.when(~F.isnan("x"), F.col("x"))), sample(spark)
    key = lambda r: (r.row_id, r.draw)
    one, many = (sorted(ensemble.complete(df.repartition(n), [s, s], ["b", "c", "x"], 3, 1).collect(), key=key) for n in (1, 7))
    assert one == many and [key(r) for r in one] == [(i, j) for i in range(4000) for j in range(3)]
    given = {r.row_id: r for r in df.collect()}
    for r in one:
        g = given[r.row_id]
        assert all(r[f] is not None and g[f] in (None, r[f]) for f in "abcx")
    assert len({r.c for r in one if given[r.row_id].c is None}) > 2


# -- F3: search ----------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("limit", [1, 50, 3000, 5000])
def test_search_scores_equal_rows_once_and_finds_what_scoring_all_rows_finds(spark, monkeypatch, limit):
    df, s = repeated(spark).withColumn("external_id", F.concat(F.lit("r"), F.lpad(F.col("row_id").cast("string"), 5, "0"))), sample(spark)
    t = PredictiveTable(spark, [Feature("a", "dd", {str(i): i for i in range(3)}), Feature("b", "bb"), Feature("c", "gp"), Feature("x", "nich")], [s, s], df)
    want = [(r.external_id, r.score) for r in ensemble.derivative(df, [s, s], [t.encode_row({"a": "1", "c": 3})], 0, ("external_id",)).orderBy(F.desc("score"), "row_id").limit(limit).collect()]
    scored, derivative = [], ensemble.derivative
    monkeypatch.setattr(ensemble, "derivative", lambda df, *args: scored.append(df.count()) or derivative(df, *args))
    got = [(r.external_id, r.score) for r in t.search({"a": "1", "c": 3}, limit).collect()]
    assert scored[0] <= 3 * 3 * 3 * 4
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want]) and len(got) == min(limit, 4000)
    assert sorted(g[0] for g in got if g[1] > got[-1][1] + 1e-9) == sorted(w[0] for w in want if w[1] > want[-1][1] + 1e-9)


def test_search_finds_columns_of_any_name(spark):
    df = spark.range(60).select(F.col("id").alias("row_id"), F.col("id").cast("string").alias("external_id"), (F.col("id") % 2).cast("int").alias("score"), (F.col("id") % 3).alias("d.mod"))
    models = {"score": "dd", "d.mod": "gp"}
    hypers = {"score": {"alphas": np.full(2, 0.5)}, "d.mod": {"alpha": 1.0, "inv_beta": 1.0}}
    s = cc.Sample(models, hypers, [cc.Kind(list(models), 2.0, 0.1, np.zeros(1), {f: MODELS[m].empty(hypers[f], 1) for f, m in models.items()})])
    cols = {"score": (np.arange(60) % 2, np.ones(60, bool)), "d.mod": (np.arange(60) % 3, np.ones(60, bool))}
    s.kinds[0].counts, s.kinds[0].stats, s.rows = np.array([60.0]), {f: MODELS[m].from_rows(hypers[f], cols[f][0], np.zeros(60, np.int64), 1) for f, m in models.items()}, 60
    t = PredictiveTable(spark, [Feature("score", "dd", {"0": 0, "1": 1}), Feature("d.mod", "gp")], [s.with_empty()], df)
    assert {int(r.external_id) % 2 for r in t.search({"score": "1"}, 20).collect()} == {1}


def test_numbers_are_encoded_the_same_from_numbers_and_texts(spark):
    df = spark.createDataFrame([(1, 0.1, 3), (2, float("nan"), None), (3, None, -4), (4, -0.0, 2**53 + 1), (5, 1e-310, 0), (6, float("inf"), 1)], "row_id bigint, x double, n bigint")
    features = [Feature("n", "gp"), Feature("x", "nich")]
    text = encode(df.withColumns({c: F.col(c).cast("string") for c in ("x", "n")}), features)
    assert [repr(r) for r in encode(df, features).orderBy("row_id").collect()] == [repr(r) for r in text.orderBy("row_id").collect()]

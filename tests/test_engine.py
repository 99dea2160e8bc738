import csv
import gzip
import io
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulon.functions import crosscat as cc
from tabulon.operators import consensus, ensemble, sparsify
from tabulon.plans import encode as enc
from tabulon.plans import transforms as tr
from tabulon.plans.schema import OTHER, Feature, SchemaError, canonical, check_columns, parse_fluent
from tabulon.sources import store as stores
from tabulon.sources import tables as src
from tabulon.streaming import single_pass
from tabulon.table import PredictiveTable, group_summary, histogram, matrix, most_related

FLUENT = [
    ("id", "id"), ("b", "boolean"), ("c", "categorical"), ("u", "unbounded_categorical"), ("n", "count"), ("r", "real"), ("s", "sparse_real"), ("p", "percent"), ("d", "date"), ("e", "optional_date"),
    ("t", "text"), ("g", "tags"), ("oc", "optional_categorical"), ("on", "optional_count"), ("unused", ""),
]
CELLS = {
    "b": ["0", "1", "true", "False"], "c": ["Monday", "June"], "u": ["CRM", "90210"], "n": ["0", "3"], "r": ["-100.0", "1e-4"], "s": ["0", "0", "0", "123456.78"], "p": ["12.5%", "3%"],
    "d": ["2014-03-31", "1979-08-01 22:00:00"], "e": ["2015-01-01"], "t": ["This is a text feature.", "Hello World!"], "g": ["", "big_data platform"], "oc": ["x", "Y"], "on": ["1", "2"], "unused": ["z"],
}


def fluent(spark, n=60):
    rng = np.random.default_rng(0)
    rows = [[str(i), *[rng.choice(CELLS[c]) if rng.random() < 0.6 else "" for c, _ in FLUENT[1:]]] for i in range(n)]
    return src.from_rows(spark, [c for c, _ in FLUENT], rows)


def test_every_fluent_type_goes_forth_and_back(spark):
    df = fluent(spark)
    plan = tr.TransformPlan.from_json(tr.make_plan(df, FLUENT).to_json())
    e = enc.make_encoding(plan.forward(df, ["id"]), plan.models())
    rows = enc.encode(plan.forward(df, ["id"]), e, "id")
    back = {r.row_id: r for r in plan.backward(enc.decode(rows, e, ["row_id"]).withColumns({f.name: F.col(f"`{f.name}`").cast("boolean") if f.model == "bb" else F.col(f"`{f.name}`").cast("double") if f.model == "nich" else F.col(f"`{f.name}`") for f in e}), ["row_id"]).collect()}
    for r in df.collect():
        b = back[int(r.id)]
        assert (b.c, b.u) == (r.c and r.c.lower(), r.u and r.u.lower())
        assert b.b == ({"0": "0", "False": "0", "1": "1", "true": "1"}[r.b] if r.b else None)
        assert b.oc == (r.oc.lower() if r.oc else None) and b.on == r.on
        assert (b.s is None) == (r.s is None) and (r.s is None or float(b.s) == float(r.s))
        assert r.p is None or float(b.p[:-1]) == pytest.approx(float(r.p[:-1]))
        assert r.d is None or b.d.startswith(r.d[:10])
        assert r.t is None or set(b.t.split()) == {w for w in "".join(x if x.isalnum() else " " for x in r.t.lower()).split()}
    assert {f.name for f in e} >= {"e.present", "e.value.absolute", "e.value.minus.d", "d.mod.week", "s.nonzero", "t.hello"}
    assert "d.minus.e" not in {f.name for f in e}


def test_canonical_order_and_set_expansion(spark):
    f = canonical([Feature("z", "nich"), Feature("b", "dd", {"x": 0, "y": 1}), Feature("a", "dd", {"x": 0, "y": 1, "z": 2}), Feature("q", "gp"), Feature("k", "bb"), Feature("o", "dpd")])
    assert [x.name for x in f] == ["k", "b", "a", "o", "q", "z"]
    plan = tr.make_plan(fluent(spark), FLUENT)
    assert plan.forward_set(["d"]) == {"d.absolute", "d.mod.year", "d.mod.month", "d.mod.week", "d.mod.day"}


@pytest.mark.parametrize("schema", [[], [("a", "")], [("a", "id")], [("a", "wrong")], [("a", "real"), ("a", "count")], [("a", "optional_id")]])
def test_bad_schemas(schema):
    with pytest.raises(SchemaError):
        parse_fluent(schema)


@pytest.mark.parametrize("found", [["a"], ["a", "a", "b"], ["x", "y"]])
def test_bad_headers(found):
    with pytest.raises(SchemaError):
        check_columns(["a", "b"], found)
    check_columns(["a", "b"], ["x", "b", "a", "y"])


def test_codes_by_count_then_value_and_unknown_values(spark):
    df = src.from_rows(spark, ["c", "u"], [["b", "p"], ["a", "p"], ["b", "q"], [" a ", ""], ["c", "q"], ["", ""]])
    e = {f.name: f for f in enc.make_encoding(df, {"c": "dd", "u": "dpd"})}
    assert e["c"].symbols == {"a": 0, "b": 1, "c": 2} and e["u"].symbols == {"p": 0, "q": 1, OTHER: 2}
    assert [f.name for f in enc.from_json(enc.to_json(list(e.values())))] == list(e)
    new = src.from_rows(spark, ["row_id", "c", "u"], [["1", "a", "never"]])
    assert enc.encode(new, list(e.values())).first().u == 2
    with pytest.raises(Exception, match="bad value of c"):
        enc.encode(src.from_rows(spark, ["row_id", "c", "u"], [["1", "zz", "p"]]), list(e.values())).collect()
    with pytest.raises(SchemaError):
        enc.make_encoding(src.from_rows(spark, ["u"], [[OTHER]]), {"u": "dpd"})
    with pytest.raises(SchemaError):
        enc.make_encoding(df, {"c": "what"})
    with pytest.raises(SchemaError):
        enc.make_encoding(df, {})
    with pytest.raises(SchemaError):
        enc.make_encoding(spark.range(300).select(F.col("id").cast("string").alias("c")), {"c": "dd"})


def test_large_dictionaries_are_joined(spark):
    df = spark.range(1000).select(F.col("id").alias("row_id"), F.concat(F.lit("v"), F.col("id") % 500).alias("u"))
    e = enc.make_encoding(df, {"u": "dpd"})
    assert len(e[0].symbols) == 501
    assert enc.decode(enc.encode(df, e), e, ["row_id"]).join(df.withColumnRenamed("u", "w"), "row_id").where("u != w or u is null").count() == 0


def test_csv_files_gz_folders_and_broken_ones(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.csv").write_text("x,y\n1,\n2,b\n")
    with gzip.open(tmp_path / "a" / "2.csv.gz", "wt") as f:
        f.write("x,y\n3,c\n")
    df = src.read_csv(spark, str(tmp_path / "a"))
    assert sorted((r.x, r.y) for r in df.collect()) == [("1", None), ("2", "b"), ("3", "c")]
    ids = src.with_row_ids(df).collect()
    assert sorted(r.row_id for r in ids) == [0, 1, 2] and all(".csv" in r.external_id for r in ids)
    src.repartition_csv(spark, str(tmp_path / "a"), str(tmp_path / "b"), 2)
    assert src.read_csv(spark, str(tmp_path / "b")).count() == 3
    (tmp_path / "a" / "3.csv").write_text("x,z\n3,c\n")
    with pytest.raises(SchemaError):
        src.read_csv(spark, str(tmp_path / "a"))
    (tmp_path / "r.csv").write_text("x,x\n1,2\n")
    with pytest.raises(SchemaError):
        src.read_csv(spark, str(tmp_path / "r.csv"))
    (tmp_path / "short.csv").write_text("x,y\n1\n")
    with pytest.raises(Exception):
        src.read_csv(spark, str(tmp_path / "short.csv")).collect()
    with pytest.raises(SchemaError):
        src.read_csv(spark, str(tmp_path / "none"))
    (tmp_path / "schema.csv").write_text("Name,Type\nx,real\ny,\n")
    assert src.load_schema(str(tmp_path / "schema.csv")) == [("x", "real"), ("y", "")]


def test_export_handles_and_cleansing(spark, tmp_path):
    e = [Feature("c", "dd", {"a": 0, "b": 1}), Feature("n", "gp")]
    rows = spark.createDataFrame([(i, i % 2 if i % 3 else None, i) for i in range(25)], "row_id bigint, c int, n bigint")
    assert src.export_rows(rows, e, str(tmp_path / "out"), 10) == 3
    got = src.read_csv(spark, str(tmp_path / "out"))
    assert got.columns == ["_id", "c", "n"] and got.where("c is null").count() == 9
    text = src.to_csv_text(got.orderBy(F.col("_id").cast("int")).limit(2))
    assert list(csv.reader(io.StringIO(text)))[0] == ["_id", "c", "n"]
    assert src.read_any(spark, io.StringIO("a,b\n1,\n")).first().b is None
    assert src.read_any(spark, pd.DataFrame({"a": ["1", None]})).count() == 2
    assert src.force_ascii(spark.createDataFrame([("né–x",)], "t string"), ["t"]).first().t == "nx"
    assert src.chunk_count(0) == 1 and src.chunk_count(10, 3) == 4


def test_tares_restore_rows(spark):
    rows = [(i, i % 5 == 0 if i % 7 else None, 3 if i % 4 else i, None if i == 1 else 20) for i in range(40)]
    df = spark.createDataFrame(rows, "row_id bigint, b boolean, n bigint, big bigint")
    usual = sparsify.tare_dict(df, ["b"], ["n", "big"])
    assert usual == {"b": 0, "n": 3}
    d = sparsify.sparsify(df, ["b", "n", "big"], usual, ["row_id"])
    assert d.where("n_pos is null and n_neg is null").count() == 30
    back = {r.row_id: (r.b, r.n, r.big) for r in sparsify.restore(d, ["b", "n", "big"], usual, ["row_id"]).collect()}
    assert back == {i: (None if b is None else int(b), n, big) for i, b, n, big in rows}
    assert sparsify.tare_dict(df.where("false"), ["b"], ["n"]) == {}


def test_splits_and_shuffles_ignore_partitioning(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    cut = lambda d: {r.k for r in enc.random_split(d, "k", 333, 5).where("train").collect()}
    assert len(cut(df)) == 333 and cut(df) == cut(df.repartition(7)) and cut(df) != {r.k for r in enc.random_split(df, "k", 333, 6).where("train").collect()}
    order = lambda d: [r.k for r in enc.shuffled(d, "k", 2).collect()]
    assert order(df) == order(df.repartition(3)) and sorted(order(df)) == list(range(1000)) != order(df)
    assert sorted(r.row_id for r in enc.dense_ids(df.repartition(5)).collect()) == list(range(1000))


def parts(spark, groupings):
    return spark.createDataFrame([(i, s, int(g)) for s, gs in enumerate(groupings) for i, g in enumerate(gs)], "row_id bigint, sample int, grp int")


def test_consensus_of_equal_noisy_and_outlying_groupings(spark):
    base = np.repeat([0, 1, 2, 3], [40, 30, 20, 10])
    perfect = consensus.consensus(parts(spark, [base] * 5)).collect()
    assert [r.group_id for r in perfect] == sorted(r.group_id for r in perfect) and all(r.confidence == 1 for r in perfect)
    assert {r.row_id: r.group_id for r in perfect} == dict(enumerate(base.tolist()))
    noisy = []
    for k in range(5):
        g = base.copy()
        g[k::25] = (g[k::25] + 1) % 4
        noisy.append(g)
    got = {r.row_id: r.group_id for r in consensus.consensus(parts(spark, noisy)).collect()}
    assert got == dict(enumerate(base.tolist()))
    out = consensus.consensus(parts(spark, [base, base, base, np.zeros(100, int), np.arange(100)])).collect()
    assert len(out) == 100 and all(0 < r.confidence <= 1 for r in out)


def lines(spark, n=240):
    rng = np.random.default_rng(4)
    z = rng.integers(0, 2, n)
    rows = [(i, "A" if k else "B", float(rng.normal(20 * k, 1)), int(rng.poisson(3)), "x" if rng.random() < 0.5 else "y") for i, k in enumerate(z.tolist())]
    return spark.createDataFrame(rows, "row_id bigint, cls string, val double, cnt bigint, coin string"), z


MODELS = {"cls": "dd", "val": "nich", "cnt": "gp", "coin": "dd"}


@pytest.fixture(scope="module")
def learnt(spark):
    df, z = lines(spark)
    return PredictiveTable.fit(spark, df, models=MODELS, samples=3), z


def test_relate_is_symmetric_with_ones_and_finds_the_pair(learnt):
    t, _ = learnt
    long = t.relate(count=300)
    m = matrix(long).toPandas().set_index("target")
    a = m[m.index].to_numpy(float)
    assert np.allclose(a, a.T) and np.allclose(np.diag(a), 1) and ((a >= 0) & (a <= 1)).all()
    assert m.loc["cls", "val"] > 0.6 and m.loc["coin", "val"] < 0.4
    assert [r.target for r in most_related(long, "val", 2).collect()] == ["val", "cls"]
    assert t.relate(["cls"], rows="all", count=50).count() == 4


def test_scores_don_t_depend_on_partitions_and_none_is_zero(spark, learnt):
    t, _ = learnt
    key = lambda d: {r.row_id: round(r.score, 9) for r in d.collect()}
    assert key(ensemble.score(t.rows.repartition(5), t.samples)) == key(ensemble.score(t.rows.coalesce(1), t.samples))
    none = t.rows.limit(1).select("row_id", *[F.lit(None).cast(k).alias(c) for c, k in t.rows.dtypes if c != "row_id"])
    assert ensemble.score(none, t.samples).first().score == pytest.approx(0, abs=1e-9)


def test_predict_keeps_what_is_seen_and_fills_the_rest(spark, learnt):
    t, _ = learnt
    q = spark.createDataFrame([("r1", "A", None, "3", None), ("r2", None, "0.1", None, "x")], "name string, cls string, val string, cnt string, coin string")
    got = t.predict(q, 20, "name").collect()
    assert len(got) == 40 and all(r.cls and r.val and r.cnt and r.coin for r in got)
    assert all(r.cls == "A" and r.cnt == "3" for r in got if r.external_id == "r1")
    assert np.mean([r.cls == "B" for r in got if r.external_id == "r2"]) > 0.7
    assert np.mean([float(r.val) for r in got if r.external_id == "r1"]) > 10
    again = t.predict(q.repartition(2), 20, "name").collect()
    assert sorted((r.draw, r.val) for r in got if r.external_id == "r1")[0][0] == 0 and len(again) == 40
    with pytest.raises(ValueError):
        t.predict(q, 1, "cls")
    assert histogram(t.predict(q, 4, "name"), "external_id", "cls").count() == 2


def test_refine_support_search_similar_group_cluster(learnt):
    t, z = learnt
    r = t.refine(["val"], ["cls", "coin"], {"cnt": 2}, count=200)
    assert {(x.target, x.query) for x in r.collect()} == {("val", "cls"), ("val", "coin")}
    s = {x.query: x.relatedness for x in t.support(["cls"], ["val", "cnt"], {"cls": "A", "val": 20.0, "cnt": 2}, count=200).collect()}
    assert s["val"] > s["cnt"]
    best = t.search({"cls": "A", "val": 20.0}, 20).collect()
    assert len(best) == 20 and best[0].score >= best[-1].score and np.mean([z[int(x.external_id)] for x in best]) > 0.8
    m = {(x.i, x.j): x.score for x in t.similar([{"cls": "A", "val": 20.0}, {"cls": "B", "val": 0.0}]).collect()}
    assert m[0, 0] > m[0, 1] and m[1, 1] > m[1, 0]
    g = t.group("val").collect()
    assert len(g) == len(z) and sorted({x.group_id for x in g}) == list(range(len({x.group_id for x in g})))
    assert group_summary(t.group("val")).first().rows > 50
    c = t.cluster([{"cls": "A", "val": 20.0}, {"cls": "B", "val": 0.0}, {"cls": "A", "val": 21.0}], clusters=2)
    assert c[0] == c[2] != c[1]


@pytest.mark.parametrize("call", [
    lambda t: t.relate([[]]), lambda t: t.relate(["nope"]), lambda t: t.relate([["cls", "val"], ["val"]]), lambda t: t.relate([["cls"], ["cls"]]),
    lambda t: t.refine(["val"], ["cls"], {"cls": "A"}), lambda t: t.refine([["val", "cls"]], [["cls"]], {}), lambda t: t.support(["cls"], ["val"], {}), lambda t: t.support(["cls"], ["val"], {"cnt": 1}),
    lambda t: t.encode_row({"cls": "never"}), lambda t: t.encode_row(["A"]), lambda t: t.encode_row({"val": "x"}), lambda t: t.encode_row({"other": 1}),
])
def test_bad_questions_are_value_errors(learnt, call):
    with pytest.raises(ValueError):
        call(learnt[0])


def test_rows_encode_and_decode(learnt):
    t, _ = learnt
    e = t.encode_row(["A", "", "2", "1.5"])
    assert t.decode_row(e) == {"cls": "A", "val": "1.5", "cnt": "2", "coin": None} and t.feature_names == ["cls", "coin", "cnt", "val"]
    assert t.converters["cls"]("") is None and t.rowid_map.count() == 240


def test_models_are_saved_and_loaded(spark, learnt, tmp_path):
    t, _ = learnt
    s = stores.Store(str(tmp_path), "lines")
    stores.save_samples(spark, s, t.samples)
    again = stores.load_samples(spark, s)
    assert [x.log_likelihood() for x in again] == pytest.approx([x.log_likelihood() for x in t.samples])
    assert s.samples() == [0, 1, 2]
    with pytest.raises(FileNotFoundError):
        s.require(s.ingest("rows"))
    with pytest.raises(ValueError):
        s.sample(0, "nothing")
    s.clean()
    assert not os.path.exists(s.path())


def test_block_gibbs_keeps_every_row_and_held_out_scores_are_sane(spark, learnt):
    t, _ = learnt
    new = ensemble.gibbs_pass(t.rows, t.samples, 1)
    assert all(k.counts.sum() == 240 for s in new for k in s.kinds)
    one = new[0].kinds[new[0].kind_of("val")]
    st = one.stats["val"]
    v = np.array([r.val for r in t.rows.select("val").collect()])
    assert (st["n"] * st["mean"]).sum() == pytest.approx(v.sum()) and (st["m2"] + st["n"] * st["mean"] ** 2).sum() == pytest.approx((v**2).sum())
    r = ensemble.held_out(t.rows, t.features, 0.9, 1, samples=1, config=cc.Config(extra_passes=1), learn_rows=500).first()
    assert r.rows == 24 and -20 < r.mean_score < 0


def test_learning_an_empty_table(spark):
    df, _ = lines(spark)
    t = PredictiveTable.fit(spark, df.where("row_id < 0"), models={"val": "nich", "cnt": "gp"}, samples=1)
    assert t.samples[0].rows == 0


def test_stream_adds_each_batch_once(spark, learnt, tmp_path):
    t, _ = learnt
    t.rows.repartition(3).write.parquet(str(tmp_path / "in"))
    make = lambda: single_pass.StreamLearner(spark, t.samples, str(tmp_path / "state"))
    learner = make()
    stream = spark.readStream.schema(t.rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    single_pass.learn_stream(stream, learner, str(tmp_path / "cp")).awaitTermination()
    assert all(s.rows == 480 for s in learner.samples)
    again = make()
    assert again.done == learner.done and all(s.rows == 480 for s in again.samples)
    again(t.rows, again.done)
    assert all(s.rows == 480 for s in again.samples)
    for style in ("full", "partial", "brief"):
        assert single_pass.watch(spark, str(tmp_path / "state"), style)
    assert single_pass.watch(spark, str(tmp_path / "nowhere")) == []

"""One query per operator of the predictive-table engine, over the sample tables. Deterministic ones have SQL equivalents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.functions import crosscat as cc
from tabulon.functions import grids, schedules
from tabulon.functions.models import MODELS as FEATURE_MODELS
from tabulon.operators import consensus, ensemble, sparsify, suffstats
from tabulon.plans import encode as enc
from tabulon.plans import transforms as tr
from tabulon.plans.schema import Feature
from tabulon.runtime import Query, hash_unit, shared_folder, table
from tabulon.sources import tables as src
from tabulon.streaming import single_pass
from tabulon.table import PredictiveTable, group_summary, histogram, matrix

#: Columns of lineitem that are modelled.
MODELS = {"l_quantity": "gp", "l_discount": "nich", "l_tax": "nich", "l_returnflag": "dd", "l_linestatus": "dd", "l_linenumber": "gp"}


# -- transforms ----------------------------------------------------------------------------------------------------
def lower_categorical(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select("c_custkey", F.lower(tr.cell("c_mktsegment")).alias("segment"))


def percent_forward(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "loans").select("id", F.round(tr.percent(tr.cell("int_rate")), 6).alias("rate"))


def percent_backward(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "loans").select("id", tr.percent(tr.cell("int_rate")).alias("rate"))
    return t.select("id", F.concat(F.round(F.col("rate") * 100, 2).cast("decimal(10,2)").cast("string"), F.lit("%")).alias("int_rate"))


def presence(s: SparkSession, d: str) -> DataFrame:
    step = tr.Step("emp_title", "text", True)
    f = step.forward()
    return table(s, d, "loans").select("id", f["emp_title.present"].alias("present"), tr.cell("emp_title").alias("value"))


def sparse_real_forward(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "loans")
    plan = tr.make_plan(t.select("id", F.col("recoveries").cast("string").alias("recoveries")), [("recoveries", "sparse_real")])
    f = plan.steps[0].forward()
    return t.select("id", f["recoveries.nonzero"].alias("nonzero"), f["recoveries.value"].alias("value"))


def sparse_real_round_trip(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "loans").select("id", "recoveries", F.col("recoveries").cast("string").alias("r"))
    plan = tr.make_plan(t.select("r"), [("r", "sparse_real")])
    return plan.backward(plan.forward(t, ["id", "recoveries"]), ["id", "recoveries"]).select("id", F.col("r").cast("double").alias("recoveries"))


def date_parts(s: SparkSession, d: str) -> DataFrame:
    p = tr.date_parts(F.col("o_orderdate").cast("timestamp_ntz"))
    return table(s, d, "orders").select("o_orderkey", F.round(p["absolute"], 6).alias("absolute"), *[p[f"mod.{x}"].alias(f"mod_{x}") for x in ("year", "month", "week", "day")])


def date_relative(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select("o_orderkey", "o_orderdate")
    j = table(s, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("l_orderkey", "l_linenumber", F.round(tr.days(F.col("l_shipdate").cast("timestamp_ntz"), F.col("o_orderdate").cast("timestamp_ntz")), 6).alias("shipped_after"))


def date_backward(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "events").select("event_id", F.col("ts").cast("string").alias("ts"))
    plan = tr.make_plan(t, [("ts", "date")])
    return plan.backward(plan.forward(t, ["event_id"]), ["event_id"]).select("event_id", F.substring("ts", 1, 19).alias("ts"))


def word_doc_freq(s: SparkSession, d: str) -> DataFrame:
    return tr.document_frequency(table(s, d, "part"), "p_name")


def vocab_filter(s: SparkSession, d: str) -> DataFrame:
    return tr.vocabulary(table(s, d, "loans"), "emp_title")


def word_presence(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "loans").select("id", "emp_title")
    step = tr.make_plan(t, [("emp_title", "text")]).steps[0]
    f = step.forward()
    held = F.array(*[F.struct(F.lit(w).alias("word"), f[f"emp_title.{w}"].alias("held")) for w in step.words])
    return t.select("id", F.inline(held)).where("held is not null")


def parse_boolean(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "doc_labels").select("doc_id", "annotator", F.when(F.col("toxic") == 1, "t").otherwise("0.0").alias("b"))
    return t.select("doc_id", "annotator", tr.boolean(F.col("b")).alias("toxic"))


def basic_schema(s: SparkSession, d: str) -> DataFrame:
    """What a fluent schema becomes, in canonical order."""
    t = table(s, d, "loans")
    t = t.select(*[F.col(c).cast("string").alias(c) for c in t.columns])
    plan = tr.make_plan(t, [("id", "id"), ("grade", "categorical"), ("loan_amnt", "real"), ("delinq_2yrs", "count"), ("purpose", "unbounded_categorical"), ("issue_d", "date"), ("mths_since_last_delinq", "optional_count"), ("int_rate", "percent")])
    e = enc.make_encoding(plan.forward(t), plan.models())
    return s.createDataFrame([(i, f.name, f.model, f.codes) for i, f in enumerate(e)], "feature_id int, name string, model string, codes int")


# -- encoding ------------------------------------------------------------------------------------------------------
def symbol_codes(s: SparkSession, d: str) -> DataFrame:
    return enc.symbol_codes(table(s, d, "part"), ["p_brand", "p_type"])


def encode_rows(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "orders")
    f = enc.make_encoding(t, {"o_orderstatus": "dd", "o_orderpriority": "dpd", "o_totalprice": "nich"})
    return enc.encode(t, f, "o_orderkey").select("row_id", "o_orderstatus", "o_orderpriority", "o_totalprice")


def decode_rows(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "orders")
    f = enc.make_encoding(t, {"o_orderstatus": "dd", "o_orderpriority": "dpd"})
    return enc.decode(enc.encode(t, f, "o_orderkey"), f, ["row_id"])


def rowid_interleave(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 4).cast("int").alias("part"))
    return enc.interleaved_ids(t, "part", ["o_orderkey"], 4).select("o_orderkey", "row_id")


def dense_row_ids(s: SparkSession, d: str) -> DataFrame:
    return enc.dense_ids(table(s, d, "orders").select("o_orderkey")).agg(F.min("row_id").alias("lo"), F.max("row_id").alias("hi"), F.count_distinct("row_id").alias("ids"))


def long_form(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("price"), (F.col("o_custkey") % 5).cast("int").alias("five"))
    return enc.long_form(t, [Feature("price", "nich"), Feature("five", "gp")], ["row_id"])


def export_chunks(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "orders").agg(F.count(F.lit(1)).alias("n"))
    return t.select("n", F.greatest(F.lit(1), F.ceil(F.col("n") / 1000)).cast("bigint").alias("chunks"))


def csv_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Rows exported as CSV files and read back, cell by cell text."""
    folder = shared_folder(s, "csv") + "/nation"
    t = table(s, d, "nation")
    src.write_csv(t.select(*[F.col(c).cast("string").alias(c) for c in t.columns]), folder)
    return s.read.csv(folder, header=True).select("n_nationkey", "n_name")


def force_ascii(s: SparkSession, d: str) -> DataFrame:
    return src.force_ascii(table(s, d, "documents").select("doc_id", "text"), ["text"]).select("doc_id", F.md5("text").alias("text_md5"))


def repartition_count(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "orders").select("o_orderkey").repartition(100)
    return t.groupBy(F.spark_partition_id().alias("p")).count().agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("parts"))


def bag_of_words(s: SparkSession, d: str) -> DataFrame:
    w = table(s, d, "part").select(F.col("p_partkey").alias("doc"), F.explode(tr.words(F.col("p_name"))).alias("word"))
    b = src.bag_of_words(w.withColumn("count", F.lit(1)))
    return b.select("doc", F.concat_ws(",", "words").alias("words"))


# -- tares ---------------------------------------------------------------------------------------------------------
def _small(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "N").alias("open"), F.when(F.col("l_orderkey") % 5 != 0, F.col("l_linestatus") == "O").alias("status_o"), (F.col("l_suppkey") % 3).cast("bigint").alias("third"), F.when(F.col("l_partkey") % 10 < 7, F.lit(1)).otherwise(F.col("l_partkey") % 30).cast("bigint").alias("lump"))


def column_mode(s: SparkSession, d: str) -> DataFrame:
    return sparsify.column_modes(_small(s, d), ["open", "status_o"], ["third", "lump"])


def tare_row(s: SparkSession, d: str) -> DataFrame:
    return sparsify.tare(_small(s, d), ["open", "status_o"], ["third", "lump"])


def sparsify_diff(s: SparkSession, d: str) -> DataFrame:
    t = _small(s, d)
    return sparsify.sparsify(t, ["open", "lump", "third"], sparsify.tare_dict(t, ["open"], ["lump", "third"]), ["l_orderkey", "l_linenumber"])


def undiff(s: SparkSession, d: str) -> DataFrame:
    t = _small(s, d)
    usual = sparsify.tare_dict(t, ["status_o"], ["lump"])
    return sparsify.restore(sparsify.sparsify(t, ["status_o", "lump"], usual, ["l_orderkey", "l_linenumber"]), ["status_o", "lump"], usual, ["l_orderkey", "l_linenumber"])


# -- statistics ----------------------------------------------------------------------------------------------------
KEYS = ["l_returnflag", "l_linestatus"]


def suffstats_bb(s: SparkSession, d: str) -> DataFrame:
    return suffstats.bb_stats(table(s, d, "lineitem"), KEYS, F.col("l_quantity") > 25)


def suffstats_dd(s: SparkSession, d: str) -> DataFrame:
    return suffstats.dd_stats(table(s, d, "lineitem"), KEYS, F.col("l_linenumber"))


def suffstats_gp(s: SparkSession, d: str) -> DataFrame:
    return suffstats.gp_stats(table(s, d, "lineitem"), KEYS, F.col("l_quantity")).withColumn("log_prod", F.round("log_prod", 3))


def suffstats_nich(s: SparkSession, d: str) -> DataFrame:
    return suffstats.nich_stats(table(s, d, "lineitem"), KEYS, F.col("l_discount")).select(*KEYS, "n", F.round("mean", 8).alias("mean"), F.round("m2", 6).alias("m2"))


def log_marginal_bb(s: SparkSession, d: str) -> DataFrame:
    return suffstats_bb(s, d).select(*KEYS, F.round(suffstats.bb_marginal(0.5, 0.5), 3).alias("log_marginal"))


def log_marginal_dd(s: SparkSession, d: str) -> DataFrame:
    return suffstats.dd_marginal(suffstats_dd(s, d), KEYS, 0.5, 7).withColumn("log_marginal", F.round("log_marginal", 3))


def log_marginal_gp(s: SparkSession, d: str) -> DataFrame:
    g = suffstats.gp_stats(table(s, d, "lineitem"), KEYS, F.col("l_quantity"))
    return g.select(*KEYS, F.round(suffstats.gp_marginal(2.0, 0.1), 2).alias("log_marginal"))


def log_marginal_nich(s: SparkSession, d: str) -> DataFrame:
    g = suffstats.nich_stats(table(s, d, "lineitem"), KEYS, F.col("l_discount"))
    return g.select(*KEYS, F.round(suffstats.nich_marginal(0.05, 0.1, 0.001, 1.0), 2).alias("log_marginal"))


def suffstats_dpd(s: SparkSession, d: str) -> DataFrame:
    """Counts of part names' codes by status, an unbounded category."""
    return suffstats.dd_stats(table(s, d, "lineitem").withColumn("code", F.col("l_suppkey").cast("int")), KEYS, F.col("code"))


def _base_weights(c: DataFrame) -> DataFrame:
    """Statistics with base weights of the values: their shares of all rows but one, which is that of new values."""
    n = c.groupBy("value").agg(F.sum("n").alias("v"))
    return c.join(n.withColumn("beta", F.col("v") / (F.sum("v").over(Window.partitionBy(F.lit(0))) + 1)), "value")


def log_marginal_dpd(s: SparkSession, d: str) -> DataFrame:
    g = suffstats.dpd_marginal(_base_weights(suffstats_dpd(s, d)), KEYS, F.lit(2.0), F.col("beta"))
    return g.withColumn("log_marginal", F.round("log_marginal", 2))


def _points(s: SparkSession, model: str, name: str) -> DataFrame:
    return s.createDataFrame([(i, float(v)) for i, v in enumerate(grids.of_model(model)[name])], "i int, point double")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("i", F.round("point", 9).alias("point"), F.round("score", 1).alias("score"))


def hyper_grid_bb(s: SparkSession, d: str) -> DataFrame:
    return _rounded(suffstats.grid_scores(suffstats_bb(s, d), _points(s, "bb", "alpha"), suffstats.bb_marginal(F.col("point"), 0.5)))


def hyper_grid_dd(s: SparkSession, d: str) -> DataFrame:
    """Of one alpha for all values."""
    x = suffstats_dd(s, d).crossJoin(F.broadcast(_points(s, "dd", "alphas")))
    t = x.withColumn("t", suffstats.lgamma(F.col("n") + F.col("point")) - suffstats.lgamma("point")).groupBy(*KEYS, "i", "point").agg(F.sum("n").cast("double").alias("n"), F.sum("t").alias("t"))
    a = F.col("point") * 7
    return _rounded(t.groupBy("i", "point").agg(F.sum(suffstats.lgamma(a) - suffstats.lgamma(a + F.col("n")) + F.col("t")).alias("score")))


def hyper_grid_dpd(s: SparkSession, d: str) -> DataFrame:
    x = _base_weights(suffstats_dpd(s, d)).crossJoin(F.broadcast(_points(s, "dpd", "alpha")))
    m = suffstats.dpd_marginal(x, [*KEYS, "i", "point"], F.col("point"), F.col("beta"))
    return _rounded(m.groupBy("i", "point").agg(F.sum("log_marginal").alias("score")))


def hyper_grid_gp(s: SparkSession, d: str) -> DataFrame:
    g = suffstats.gp_stats(table(s, d, "lineitem"), KEYS, F.col("l_quantity"))
    return _rounded(suffstats.grid_scores(g, _points(s, "gp", "alpha"), suffstats.gp_marginal(F.col("point"), 0.1)))


def hyper_grid_nich(s: SparkSession, d: str) -> DataFrame:
    g = suffstats.nich_stats(table(s, d, "lineitem"), KEYS, F.col("l_discount"))
    return _rounded(suffstats.grid_scores(g, _points(s, "nich", "kappa"), suffstats.nich_marginal(0.05, F.col("point"), 0.001, 1.0)))


def log_sum_exp(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "nation").select("n_regionkey", (F.col("n_nationkey") * 40.0 - 500.0).alias("x"))
    return suffstats.log_sum_exp(t, ["n_regionkey"], "x").withColumn("lse", F.round("lse", 6))


def py_grid_score(s: SparkSession, d: str) -> DataFrame:
    sizes = table(s, d, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.count(F.lit(1)).alias("size")).select("l_returnflag", "size")
    grid = s.createDataFrame([(a, b) for a in (0.5, 2.0, 10.0) for b in (0.0, 0.1, 0.5)], "alpha double, d double")
    return suffstats.partition_scores(sizes, ["l_returnflag"], grid).withColumn("score", F.round("score", 2))


def _entropy(n: DataFrame, name: str) -> DataFrame:
    t = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))
    return t.agg((-F.sum(F.col("p") * F.log("p"))).alias(name))


def _counts(s: SparkSession, d: str, *cols: str) -> DataFrame:
    return table(s, d, "lineitem").groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def empirical_entropy(s: SparkSession, d: str) -> DataFrame:
    """Entropies of two columns and of both, from one pass: the finest counts are summed further."""
    joint = _counts(s, d, *KEYS)
    one = [_entropy(joint.groupBy(k).agg(F.sum("n").alias("n")), f"h_{k}") for k in KEYS]
    r = _entropy(joint, "h_joint").crossJoin(one[0]).crossJoin(one[1])  # three one-row tables
    return r.select(*[F.round(c, 8).alias(c) for c in r.columns])


def mutual_information(s: SparkSession, d: str) -> DataFrame:
    e = empirical_entropy(s, d)
    mi = F.col("h_l_returnflag") + F.col("h_l_linestatus") - F.col("h_joint")
    return e.select(F.round(mi, 6).alias("mi"), F.round(F.sqrt(1 - F.exp(-2 * F.greatest(mi, F.lit(0.0)))), 5).alias("relatedness"))


def variance_of_mean(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg("l_discount"), 8).alias("mean"), F.round(F.var_samp("l_discount") / F.count("l_discount"), 12).alias("variance"))


# -- grids and schedules -------------------------------------------------------------------------------------------
def _grid(s: SparkSession, values) -> DataFrame:
    return s.createDataFrame([(i, round(float(v), 9)) for i, v in enumerate(values)], "i int, x double")


def grid_uniform(s: SparkSession, d: str) -> DataFrame:
    return _grid(s, grids.uniform(-1, 3, 16))


def grid_center(s: SparkSession, d: str) -> DataFrame:
    return _grid(s, grids.center_heavy(0.1, 10, 16))


def grid_left(s: SparkSession, d: str) -> DataFrame:
    return _grid(s, grids.left_heavy(0.1, 10, 16))


def grid_right(s: SparkSession, d: str) -> DataFrame:
    return _grid(s, grids.right_heavy(0.1, 10, 16))


def grid_pitman_yor(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([(i, round(a, 9), round(x, 9)) for i, (a, x) in enumerate(grids.pitman_yor())], "i int, alpha double, d double")


def accelerating_passes(s: SparkSession, d: str) -> DataFrame:
    rows = [(10**k, round(schedules.extra_passes(10**k), 6)) for k in range(1, 11)]
    return s.createDataFrame(rows, "rows bigint, passes double")


def annealing_actions(s: SparkSession, d: str) -> DataFrame:
    each = (what == "add" for what, first, last in schedules.actions(1000, 1.5) if what != "redraw" for _ in range(first, last))
    return s.createDataFrame(list(zip(range(60), each)), "i int, is_add boolean")


# -- groups --------------------------------------------------------------------------------------------------------
def _partitions(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer").select(F.col("c_custkey").alias("row_id"), F.array((F.col("c_custkey") % 4).cast("int"), F.when(F.col("c_custkey") % 4 < 2, 0).otherwise(1), F.when(F.col("c_custkey") % 11 == 0, 5).otherwise((F.col("c_custkey") % 4).cast("int"))).alias("g"))
    return c.select("row_id", F.posexplode("g").alias("sample", "grp"))


def jaccard_groups(s: SparkSession, d: str) -> DataFrame:
    o = consensus.overlaps(_partitions(s, d)).where("a.sample != b.sample")
    return o.select(F.col("a.sample").alias("sample_a"), F.col("a.grp").alias("grp_a"), F.col("b.sample").alias("sample_b"), F.col("b.grp").alias("grp_b"), "overlap", F.round("jaccard", 8).alias("jaccard"))


def group_consensus_confidence(s: SparkSession, d: str) -> DataFrame:
    p = _partitions(s, d).withColumn("part", F.col("grp") % 4)
    return consensus.vote(p.select("row_id", "part"), 3).withColumn("confidence", F.round("confidence", 6))


def size_sorted_ids(s: SparkSession, d: str) -> DataFrame:
    return consensus.size_ranks(_partitions(s, d).withColumn("kind", F.lit(0)))


def rowid_join(s: SparkSession, d: str) -> DataFrame:
    """Groups joined back to the users' ids."""
    ids = table(s, d, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_name").alias("external_id"))
    return _partitions(s, d).where("sample = 2").join(ids, "row_id").select("external_id", "grp")


def assign_kind_join(s: SparkSession, d: str) -> DataFrame:
    """The groups of the kind that holds a feature, per sample."""
    kinds = s.createDataFrame([(0, 0, "x"), (0, 1, "y"), (1, 1, "x"), (1, 0, "y"), (2, 0, "x"), (2, 0, "y")], "sample int, kind int, feature string")
    a = _partitions(s, d).withColumn("kind", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("grp", F.col("grp") + 10 * F.col("kind"))
    own = kinds.where("feature = 'x'").select("sample", "kind")
    return a.join(own, ["sample", "kind"]).groupBy("sample", "kind", "grp").agg(F.count(F.lit(1)).alias("n"))


def knn_vote(s: SparkSession, d: str) -> DataFrame:
    """Labels of the embeddings whose ids 20 divides by their ten nearest among all others, by cosine."""
    e = table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")
    e = e.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("row_id"), F.col("v").alias("w"), F.col("norm").alias("own_norm"))
    pairs = e.crossJoin(asked).where("vec_id != row_id")  # a stated query set against all rows; each task keeps ten per query
    dot = F.aggregate(F.zip_with("v", "w", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    sim = pairs.select("row_id", F.col("vec_id").alias("seed_id"), F.round(dot / (F.col("norm") * F.col("own_norm")), 9).alias("score"))
    return consensus.neighbours_vote(sim, e.select(F.col("vec_id").alias("seed_id"), "label"))


def predict_histogram(s: SparkSession, d: str) -> DataFrame:
    h = histogram(table(s, d, "orders"), "o_orderstatus", "o_orderpriority")
    return h.select("o_orderstatus", *[F.round(F.col(f"`{c}`"), 8).alias("p_" + c[0]) for c in h.columns[1:]])


def print_groups(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "orders").select(F.col("o_orderstatus").alias("group_id"), (F.col("o_orderkey") % 17 / 16).alias("confidence"), F.format_string("%010d", "o_orderkey").alias("external_id"))
    return group_summary(g).withColumn("weight", F.round("weight", 4))


def pixel_counts(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "fox").where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    return t.groupBy(F.floor((F.col("x") + 1) * 16).alias("px"), F.floor((F.col("y") + 1) * 16).alias("py")).agg(F.count(F.lit(1)).alias("n"))


def semi_join_rows(s: SparkSession, d: str) -> DataFrame:
    keep = table(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(s, d, "customer").join(keep, "c_custkey", "left_semi").select("c_custkey", "c_name")


def seeded_split(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "orders").select("o_orderkey")
    n = t.count()
    return enc.random_split(t, "o_orderkey", int(n * 0.9)).groupBy("train").agg(F.count(F.lit(1)).alias("n"))


def seeded_shuffle(s: SparkSession, d: str) -> DataFrame:
    return enc.shuffled(table(s, d, "orders").select("o_orderkey"), "o_orderkey", 3)


def stream_stats(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").agg(F.count(F.lit(1)).alias("messages"), F.max(F.length("props")).alias("longest"))


def seek_rows(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").where(F.col("event_id") >= 100).select("event_id", "event_type")


# -- a fixed model: scores and samples -----------------------------------------------------------------------------
def score_groups(s: SparkSession, d: str) -> DataFrame:
    """Log predictive probability of each line's quantity class under each status group (add-half smoothed counts)."""
    t = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", F.floor(F.col("l_quantity") / 10).cast("int").alias("q"))
    c = t.groupBy(F.col("l_linestatus").alias("grp"), "q").agg(F.count(F.lit(1)).alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy("grp")))
    p = c.select("grp", "q", F.log((F.col("n") + 0.5) / (F.col("total") + 3.0)).alias("lp"))
    return t.join(p, "q").select("l_orderkey", "l_linenumber", "grp", F.round("lp", 8).alias("lp"))


def score_row(s: SparkSession, d: str) -> DataFrame:
    """The rows' scores: groups weighted by their size."""
    g = score_groups(s, d)
    w = table(s, d, "lineitem").groupBy(F.col("l_linestatus").alias("grp")).agg(F.count(F.lit(1)).alias("size")).withColumn("lw", F.log(F.col("size") / F.sum("size").over(Window.partitionBy(F.lit(0)))))
    x = g.join(w, "grp").withColumn("x", F.col("lp") + F.col("lw"))
    return suffstats.log_sum_exp(x, ["l_orderkey", "l_linenumber"], "x").withColumn("lse", F.round("lse", 6))


def topk_search(s: SparkSession, d: str) -> DataFrame:
    return score_row(s, d).orderBy(F.desc("lse"), "l_orderkey", "l_linenumber").limit(100)


FIXED = {"l_returnflag": "dd", "l_linestatus": "dd", "l_linenumber": "dd", "low": "bb"}


def fixed_model(s: SparkSession, d: str) -> tuple[DataFrame, list[cc.Sample]]:
    """lineitem, encoded, and two samples whose groups are known: rows by status in one kind, rows by flag in two kinds; one empty group each."""
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    rows = table(s, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"), flag.alias("l_returnflag"), F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("l_linestatus"), (F.col("l_linenumber") - 1).alias("l_linenumber"), (F.col("l_quantity") < 20).alias("low"))
    hypers = {"l_returnflag": {"alphas": np.full(3, 0.5)}, "l_linestatus": {"alphas": np.full(2, 0.5)}, "l_linenumber": {"alphas": np.full(7, 0.5)}, "low": {"alpha": 0.5, "beta": 1.5}}
    cells = rows.groupBy("l_returnflag", "l_linestatus", "l_linenumber", "low").count().toPandas()  # 84 at most

    def kind(by: str, groups: int, features: list[str]) -> cc.Kind:
        n = np.bincount(cells[by], cells["count"], groups)
        stats = {f: FEATURE_MODELS[FIXED[f]].empty(hypers[f], groups) for f in features}
        for f in features:
            for g, x, k in zip(cells[by], cells[f], cells["count"]):
                FEATURE_MODELS[FIXED[f]].add(hypers[f], stats[f], g, x, k)
        return cc.Kind(features, 2.0, 0.1, n, stats)

    one = cc.Sample(FIXED, hypers, [kind("l_linestatus", 2, list(FIXED))], rows=int(cells["count"].sum()))
    two = cc.Sample(FIXED, hypers, [kind("l_returnflag", 3, ["l_returnflag", "low"]), kind("l_returnflag", 3, ["l_linestatus", "l_linenumber"])], rows=one.rows)
    return rows, [one.with_empty(), two.with_empty()]


def score_fixed(s: SparkSession, d: str) -> DataFrame:
    """Scores of all rows by the engine, under a model that is known."""
    rows, samples = fixed_model(s, d)
    return ensemble.score(rows, samples).select("row_id", F.round("score", 6).alias("score"))


def score_partial(s: SparkSession, d: str) -> DataFrame:
    """Scores of rows of which some cells are unobserved."""
    rows, samples = fixed_model(s, d)
    rows = rows.withColumn("l_linenumber", F.when(F.col("row_id") % 3 != 0, F.col("l_linenumber"))).withColumn("low", F.when(F.col("row_id") % 2 != 0, F.col("low")))
    return ensemble.score(rows, samples).select("row_id", F.round("score", 6).alias("score"))


def conditional_fixed(s: SparkSession, d: str) -> DataFrame:
    """Log probability of each row's return flag given its line status, by the engine: of both less that of the status."""
    rows, samples = fixed_model(s, d)
    pairs = rows.groupBy("l_returnflag", "l_linestatus").count().select("l_returnflag", "l_linestatus", (F.col("l_returnflag") * 2 + F.col("l_linestatus")).cast("bigint").alias("row_id"))
    both = ensemble.score(pairs, samples, ("l_returnflag", "l_linestatus"))
    status = ensemble.score(pairs.select("row_id", "l_linestatus"), samples).withColumnRenamed("score", "given")
    return both.join(status, "row_id").select("l_returnflag", "l_linestatus", F.round(F.col("score") - F.col("given"), 6).alias("log_probability"))


# -- learnt models (stochastic: rows only) -------------------------------------------------------------------------
#: As on the command line; rows of the chains and passes are the operators' defaults.
SAMPLES = 10
_LEARNT: dict[tuple, PredictiveTable] = {}


def learnt(s: SparkSession, d: str, **options) -> PredictiveTable:
    """lineitem, learnt once per session, folder and options: the questions below are asked of one table, as users do. crossvalidate, which learns parts of it, doesn't wait for the whole."""
    key = (s.sparkContext.applicationId, d, repr(sorted(options.items())))
    if key not in _LEARNT:
        t = table(s, d, "lineitem").select(*[F.col(c).cast("string").alias(c) if m == "dd" else F.col(c) for c, m in MODELS.items()])
        t = t.withColumn("l_quantity", F.col("l_quantity").cast("bigint"))
        _LEARNT[key] = PredictiveTable.fit(s, t, models=MODELS, lazy=True, **{"samples": SAMPLES, **options})
    return _LEARNT[key]


def infer(s: SparkSession, d: str) -> DataFrame:
    rows = ensemble.metrics(learnt(s, d).samples)
    return s.createDataFrame([(m["sample"], m["rows"], m["kinds"], m["groups"]) for m in rows], "sample int, rows int, kinds int, groups int")


def mix(s: SparkSession, d: str) -> DataFrame:
    t = learnt(s, d)
    rows = ensemble.metrics(ensemble.mix(t.rows, t.samples, 2))
    return s.createDataFrame([(m["sample"], m["rows"], m["groups"]) for m in rows], "sample int, rows int, groups int")


def infer_single_pass(s: SparkSession, d: str) -> DataFrame:
    t = learnt(s, d, config=cc.Config(extra_passes=0.0), samples=1)
    return s.createDataFrame([(m["sample"], m["rows"], m["groups"]) for m in ensemble.metrics(t.samples)], "sample int, rows int, groups int")


def score(s: SparkSession, d: str) -> DataFrame:
    t = learnt(s, d)
    return ensemble.score(t.rows, t.samples)


def predict(s: SparkSession, d: str) -> DataFrame:
    t = learnt(s, d)
    return ensemble.complete(t.rows.withColumn("l_quantity", F.when(hash_unit(F.col("row_id")) < 0.5, F.col("l_quantity"))), t.samples, count=2)


def relate(s: SparkSession, d: str) -> DataFrame:
    return matrix(learnt(s, d).relate())


def refine(s: SparkSession, d: str) -> DataFrame:
    return learnt(s, d).refine(["l_linestatus"], None, {"l_quantity": 10})


def support(s: SparkSession, d: str) -> DataFrame:
    return learnt(s, d).support(["l_returnflag"], ["l_quantity", "l_linestatus"], {"l_quantity": 10, "l_linestatus": "O", "l_returnflag": "N"})


def search(s: SparkSession, d: str) -> DataFrame:
    return learnt(s, d).search({"l_returnflag": "A", "l_quantity": 17}, 100)


def similar(s: SparkSession, d: str) -> DataFrame:
    return learnt(s, d).similar([{"l_returnflag": "A"}, {"l_returnflag": "N", "l_linestatus": "O"}, {"l_quantity": 3}])


def group(s: SparkSession, d: str) -> DataFrame:
    return learnt(s, d).group("l_returnflag")


def cluster(s: SparkSession, d: str) -> DataFrame:
    c = learnt(s, d).cluster([{"l_returnflag": "A"}, {"l_returnflag": "N"}, {"l_returnflag": "R"}], clusters=2)
    return s.createDataFrame([(i, int(x)) for i, x in c.items()], "row int, cluster int")


def crossvalidate(s: SparkSession, d: str) -> DataFrame:
    t = learnt(s, d)
    return ensemble.held_out(t.rows, t.features, 0.9, 2, samples=SAMPLES)


def density_image(s: SparkSession, d: str) -> DataFrame:
    """Probability density of a two-dimensional table on a grid, as shares of the highest."""
    t = PredictiveTable.fit(s, table(s, d, "fox").select(F.col("point_id").alias("row_id"), "x", "y"), models={"x": "nich", "y": "nich"}, samples=SAMPLES)
    grid = s.range(32 * 32).select(F.col("id").alias("row_id"), ((F.col("id") % 32 + 0.5) / 16 - 1).alias("x"), (F.floor(F.col("id") / 32) / 16 - 1 + 1 / 32).alias("y"))
    p = ensemble.score(grid, t.samples)
    return p.withColumn("shade", F.exp(F.col("score") - F.max("score").over(Window.partitionBy(F.lit(0))))).select("row_id", "shade")


def stream_single_pass(s: SparkSession, d: str) -> DataFrame:
    """A stream of orders learnt batch by batch."""
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    features = enc.make_encoding(o, {"status": "dd", "price": "nich"})
    rows = enc.encode(o, features)
    base = shared_folder(s, "stream")
    rows.repartition(3).write.parquet(f"{base}/in")
    learner = single_pass.StreamLearner(s, lambda first: ensemble.single_pass(first, features), f"{base}/state")
    stream = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    single_pass.learn_stream(stream, learner, f"{base}/checkpoint").awaitTermination()
    return s.createDataFrame([(line,) for line in single_pass.watch(s, f"{base}/state", "partial")], "line string")


def generate(s: SparkSession, d: str) -> DataFrame:
    """Synthetic rows from a model, with three in ten cells unobserved."""
    t = learnt(s, d)
    blank = s.range(500).select(F.col("id").alias("row_id"), *[F.lit(None).cast(k).alias(c) for c, k in t.rows.dtypes if c != "row_id"])
    drawn = ensemble.complete(blank, t.samples, count=1)
    return drawn.select("row_id", *[F.when(hash_unit(F.col("row_id"), F.lit(c)) < 0.7, F.col(c)).alias(c) for c in MODELS])


QUERIES = (
    lower_categorical, percent_forward, percent_backward, presence, sparse_real_forward, sparse_real_round_trip, date_parts, date_relative, date_backward, word_doc_freq, vocab_filter,
    word_presence, parse_boolean, basic_schema, symbol_codes, encode_rows, decode_rows, rowid_interleave, dense_row_ids, long_form, export_chunks, csv_round_trip, force_ascii, repartition_count,
    bag_of_words, column_mode, tare_row, sparsify_diff, undiff, suffstats_bb, suffstats_dd, suffstats_gp, suffstats_nich, log_marginal_bb, log_marginal_dd, log_marginal_gp, log_marginal_nich,
    suffstats_dpd, log_marginal_dpd, hyper_grid_bb, hyper_grid_dd, hyper_grid_dpd, hyper_grid_gp, hyper_grid_nich, log_sum_exp, py_grid_score, empirical_entropy, mutual_information, variance_of_mean, grid_uniform, grid_center, grid_left, grid_right, grid_pitman_yor, accelerating_passes, annealing_actions, jaccard_groups,
    group_consensus_confidence, size_sorted_ids, rowid_join, assign_kind_join, knn_vote, predict_histogram, print_groups, pixel_counts, semi_join_rows, seeded_split, seeded_shuffle, stream_stats,
    seek_rows, score_groups, score_row, topk_search, score_fixed, score_partial, conditional_fixed, infer, mix, infer_single_pass, score, predict, relate, refine, support, search, similar, group, cluster, crossvalidate, density_image,
    stream_single_pass, generate,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in QUERIES}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """How the columns of lineitem are related, from a learnt ensemble."""
    return relate(spark, folder)



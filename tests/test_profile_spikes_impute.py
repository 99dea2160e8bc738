import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.operators import impute, profile, spikes
from tabulon.runtime import no_value


def loads(spark, change):
    rng = np.random.default_rng(0)
    rows = []
    for k in range(9):
        for i in range(400):
            code, count = rng.choice(["1", "2", "5"], p=[0.9, 0.07, 0.03]), int(rng.integers(1, 5))
            if k == 4:
                code, count = change(code, count, i)
            rows.append((f"L{k}", code, count, f"{i:08x}{k:04d}ABCDEF0123456789", dt.datetime(2013, 1, 1 + k, 1, 2, 3), float(i) / 4))
    return spark.createDataFrame(rows, "load string, code string, n int, id string, at timestamp, x double")


def found(df):
    return {(r.load, r.column_name) for r in profile.changed_loads(profile.forms(df, "load")).collect()}


def test_unchanged_loads_are_quiet(spark):
    assert found(loads(spark, lambda c, n, i: (c, n))) == set()


def test_nulls_forms_values_and_shares_are_noticed(spark):
    assert found(loads(spark, lambda c, n, i: (None if i % 3 == 0 else c, n))) == {("L4", "code")}
    assert found(loads(spark, lambda c, n, i: (c + ".0", n))) == {("L4", "code")}
    assert found(loads(spark, lambda c, n, i: (c, 208 if i % 4 == 0 else n))) == {("L4", "n")}
    assert found(loads(spark, lambda c, n, i: ({"1": "2", "2": "1"}.get(c, c), n))) == {("L4", "code")}


def test_masks():
    assert [profile.mask(x) for x in ("Bank card", " N", "1.0", "A440F13368CD919A7C8CE9E6BDF1114C", "", "日本")] == ["Aaaa aaaa", " A", "9.9", "X{32}", "", "AA"]
    assert profile.mask("a" * 100_000) == "a" * profile.RUN + "+"
    assert [profile.number_mask_text(c) for c in profile.number_masks(np.array([0.0, -12.25, 255, 0.1]))] == ["9", "-99.99", "999", "9.9"]


def test_profile_of_odd_tables(spark):
    df = spark.createDataFrame([("a", None, float("nan"), "x" * 50_000), (None, "v", 1.5, ""), ("a", "v", float("inf"), None)], "load string, value string, mask double, column_name string")
    got = {(r.load, r.column_name, r["mask"], r.n) for r in profile.forms(df, "load").collect()}
    assert ("a", "value", "<null>", 1) in got and (None, "mask", "9.9", 1) in got and ("a", "mask", "nan", 1) in got and (None, "column_name", "", 1) in got
    assert profile.forms(df.where("false"), "load").count() == 0
    assert profile.changed_loads(profile.forms(df.where("false"), "load")).count() == 0
    r = {(x.load, x.column_name): (x.nulls, x.low) for x in profile.ranges(df, "load").collect()}
    assert r["a", "mask"] == (1, "Infinity") and r["a", "value"] == (1, "v")
    assert {x.column_name for x in profile.mask_profile(profile.forms(df, "load")).where("dominant").collect()} == {"value", "mask", "column_name"}


def meter_rows():
    rng = np.random.default_rng(2)
    rows = []
    for m in range(6):
        for i in range(120):
            t = float(rng.integers(200, 2000))
            rows.append([m * 1000 + i, f"cab{m}", 1000 * i, t, t * 0.01 * (1.6 if m == 3 else 1.0) * float(rng.uniform(0.9, 1.1)), t])
    return rows


READ = [spikes.Reading("time", ["clock"], ["dist"], 5.0), spikes.Reading("dist", [], ["time", "clock"], 0.05)]
METER = "id bigint, source string, t bigint, time double, dist double, clock double, season int"


def flags(spark, rows, name):
    df = spark.createDataFrame([(*r, 0) for r in rows], METER)
    s = spikes.fit(df, READ, "source", "season").apply(df)
    return {r.id for r in s.where(f"spike_{name}").collect()}


@pytest.mark.parametrize("limit", [spikes.BROADCAST_SOURCES, 0])
def test_spikes_are_flagged_and_habits_are_not(spark, monkeypatch, limit):
    monkeypatch.setattr(spikes, "BROADCAST_SOURCES", limit)
    rows = meter_rows()
    rows[5][3] *= 60
    rows[200][4] *= 25
    rows[300][4] /= 30
    rows.append([9001, "cab1", 5, 40_000.0, 400.0, 40_000.0])  # long in everything
    rows.append([9002, None, 5, 900.0, 700.0, 900.0])  # no source, yet far off
    rows.append([9003, "cab1", 5, None, None, None])
    assert flags(spark, rows, "time") == {rows[5][0]}
    assert flags(spark, rows, "dist") == {rows[200][0], rows[300][0], 9002}


def test_spikes_of_an_empty_table(spark):
    assert flags(spark, [], "time") == set()


@pytest.mark.parametrize("faults", [0, 900])
def test_tail_fit_recovers_an_exponential_beside_faults(faults):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.exponential(0.1, 400_000), rng.normal(4, 1, faults)])
    bins, counts = np.unique(np.floor(np.abs(x) / 0.02).astype(int), return_counts=True)
    t = spikes.fit_tail(bins, counts, 0.02)
    assert abs(t.shape) < 0.15 and abs(t.scale - 0.1) < 0.02
    assert abs(t.cutoff(1e-4) - 0.1 * np.log(1e4)) < 0.25 and t.cutoff(1e-6) > t.cutoff(1e-4)
    assert abs(t.share - np.exp(-t.threshold / 0.1)) < 0.001


def test_tail_of_few_or_equal_readings():
    assert spikes.fit_tail(np.array([0]), np.array([1000]), 0.02).cutoff() == 0.02
    assert spikes.fit_tail(np.empty(0, int), np.empty(0, int), 0.02).cutoff() == 0.0


def test_sources_have_tails_of_their_own_and_the_risk_moves_the_cutoffs(spark):
    rng = np.random.default_rng(3)
    rows = [(m * 10_000 + i, f"cab{m}", 1000 * i, t, float(t * 0.01 * np.exp(rng.normal(0, 0.02) if rng.random() < 0.97 else rng.exponential(0.3 if m == 0 else 0.1))), t, 0) for m in range(6) for i in range(800) for t in [float(rng.integers(200, 2000))]]
    df = spark.createDataFrame(rows, METER)
    model = {r: spikes.fit(df, READ, "source", "season", risk=r) for r in (1e-5, 1e-3)}
    cut = {r: {x["__source"]: x.cutoff for x in m.habits.where("field = 1").collect()} for r, m in model.items()}
    assert all(cut[1e-5]["cab0"] > 1.2 * c for s, c in cut[1e-5].items() if s != "cab0")
    assert all(cut[1e-5][s] > cut[1e-3][s] for s in cut[1e-5])
    assert model[1e-3].apply(df).where("spike_dist").count() > model[1e-5].apply(df).where("spike_dist").count()


def test_stuck_runs_cross_chunks_skip_gaps_and_ignore_repeats(spark):
    rows = [(i, "a", i * 30_000, 5.0 if 3 <= i < 12 else float(i)) for i in range(20)]
    rows[6] = (6, "a", 6 * 30_000, None)
    rows += [(100 + i, "b", 1000, 1.0) for i in range(9)]  # one event sent nine times
    rows += [(200 + i, "c", i, 47.0) for i in range(9)] + [(300, None, 1, 2.0), (301, "d", None, 2.0)]
    df = spark.createDataFrame(rows, "id bigint, source string, t bigint, v double")
    got = spikes.stuck(df, ["v"], "source", "t", ["id"], exempt={"v": F.coalesce(F.col("v") == 47.0, F.lit(False))})
    assert got.count() == len(rows)
    assert {r.id for r in got.where("stuck_v").collect()} == {3, 4, 5, 7, 8, 9, 10, 11}
    assert spikes.stuck(df.where("false"), ["v"], "source", "t", ["id"]).count() == 0


def test_no_value_words(spark):
    texts = [(x,) for x in ("", " ", "-", "??", "N/A", "n/a", "null", "Unk.", "UNKNOWN", "type unknown", None, "VOUC", "none of these", "Out of Town", "Nan Hollow", "0")]
    got = spark.createDataFrame(texts, "x string").select("x", no_value(F.col("x"), "payment_type").alias("m")).collect()
    assert [r.m for r in got] == [True] * 11 + [False] * 5


def trips(spark, n=1500):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(n):
        card = rng.random() < 0.6
        fare = float(rng.uniform(5, 30))
        rows.append((i, "CARD" if card else "CASH", round(0.2 * fare + float(rng.normal(0, 0.3)), 2) if card else 0.0, fare, ["north", "south"][int(fare > 15)]))
    return rows


def fields():
    card = F.coalesce(F.col("pay") == "CARD", F.lit(False)).cast("double")
    return [
        impute.Field("tip", "numeric", F.col("tip").isNull() | F.isnan("tip"), [card, card * F.col("fare"), F.col("fare")], floor=0.0, value=F.col("tip")),
        impute.Field("pay", "categorical", no_value(F.col("pay"), "pay"), [F.when(F.col("tip") > 0.5, "tip").otherwise("none"), F.col("zone")]),
    ]


def test_fills_follow_the_other_fields_and_marks_tell(spark):
    rows = trips(spark)
    gone = [(i, p if i % 10 else None, t if i % 7 else float("nan"), f, z) for i, p, t, f, z in rows]
    df = spark.createDataFrame(gone, "id bigint, pay string, tip double, fare double, zone string")
    got = {r.id: r for r in impute.impute(df, "id", fields()).collect()}
    assert len(got) == len(rows)
    assert all(got[i].pay_filled == (i % 10 == 0) and got[i].tip_filled == (i % 7 == 0) for i in got)
    assert all(got[i].pay == p and abs(got[i].tip - t) < 1e-9 for i, p, t, f, z in rows if i % 10 and i % 7)
    single = [i for i in got if i % 10 == 0 and i % 7]
    assert np.mean([got[i].pay == rows[i][1] for i in single]) > 0.9
    tips = [i for i in got if i % 7 == 0 and i % 10]
    assert np.mean([abs(got[i].tip - rows[i][2]) for i in tips]) < 0.8
    assert np.std([got[i].tip - rows[i][2] for i in tips]) > 0.1  # residual variation stays


def test_imputation_is_the_same_on_other_partitions_and_survives_odd_tables(spark):
    gone = [(i, p if i % 10 else " ? ", t if i % 7 else None, f, z if i % 11 else None) for i, p, t, f, z in trips(spark, 300)] + [(None, None, None, None, None), (5, "CARD", None, 10.0, "x")]
    df = spark.createDataFrame(gone, "id bigint, pay string, tip double, fare double, zone string")
    key = lambda d: sorted((str(r.id), str(r.pay), str(r.tip)) for r in d.collect())
    assert key(impute.impute(df.repartition(7), "id", fields())) == key(impute.impute(df.coalesce(1), "id", fields()))
    assert impute.impute(df.where("false"), "id", fields()).count() == 0
    none = df.withColumn("pay", F.lit(None).cast("string")).withColumn("tip", F.lit(None).cast("double"))
    assert impute.impute(none, "id", fields()).where("pay is null and pay_filled and tip_filled").count() == len(gone)

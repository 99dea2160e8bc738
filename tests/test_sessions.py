from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabulon.operators import sessions
from tabulon.operators.sessions import TreeBuilder

SCHEMA = "entity string, start_s bigint, end_s bigint"


def brute(rows, t):
    out, cur, latest = [], None, None
    for s, e in sorted((s, max(s, e if e is not None else s)) for s, e in rows):
        if latest is None or s > latest + t:
            if cur:
                out.append(tuple(cur))
            cur = [s, e, 1]
        else:
            cur[1], cur[2] = max(cur[1], e), cur[2] + 1
        latest = e if latest is None else max(latest, e)
    return out + ([tuple(cur)] if cur else [])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 9)), min_size=1, max_size=14), st.integers(0, 40))
def test_tree_cuts_to_the_sessions_of_every_threshold(rows, t):
    rows = sorted((s, s + n) for s, n in rows)
    out = []
    b = TreeBuilder(out)
    for s, e in rows:
        b.add(s, e, 1)
    b.finish()
    assert sorted((s, e, n) for gap, parent, s, e, n in out if gap <= t < parent) == sorted(brute(rows, t))


def test_sessions_equal_brute_force_over_chunk_borders_and_thresholds(spark):
    import random

    rnd = random.Random(3)
    rows = [(e, s, s + rnd.randint(-50, 4000) if rnd.random() < 0.9 else None) for e in ("a", "b") for s in [rnd.randint(0, 400_000) for _ in range(120)]]
    rows += [("hot", s, s + 100) for s in range(0, 200_000, 90)]
    tree = sessions.gap_tree(sessions.segments(spark.createDataFrame(rows, SCHEMA), chunk=7200)).cache()
    for t in (60, 900, 2700, 30_000):
        got = sorted((r.entity, r.start_s, r.end_s, r.events) for r in sessions.cut(tree, t).collect())
        assert got == sorted((k, *x) for k in ("a", "b", "hot") for x in brute([(s, e) for n, s, e in rows if n == k], t))


def test_odd_rows(spark):
    rows = [(None, 5, 6), ("x", None, 9), ("x", 100, None), ("x", 100, 50), ("x", 100, 100), ("y", 0, 10)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("chunk", F.lit(1)).withColumn("segment", F.lit("s"))
    got = {(r.entity, r.start_s, r.end_s, r.duration_s, r.events) for r in sessions.sessions(df, 2700).collect()}
    assert got == {("x", 100, 100, 0, 3), ("y", 0, 10, 10, 1)}


def test_records_of_one_event_count_once(spark):
    rows = [("x", 100, 150, "m"), ("x", 100, 170, "m"), ("x", 100, 120, None), ("x", 100, 130, None)]
    df = spark.createDataFrame(rows, SCHEMA + ", cab string")
    got = sessions.sessions(df, 2700, same=["cab"]).collect()
    assert [(r.end_s, r.events) for r in got] == [(170, 2)]


def test_gap_of_exactly_the_threshold_joins(spark):
    df = spark.createDataFrame([("x", 0, 10), ("x", 2710, 2720), ("x", 5421, 5430)], SCHEMA)
    assert sorted((r.start_s, r.end_s) for r in sessions.sessions(df, 2700).collect()) == [(0, 2720), (5421, 5430)]


def test_empty(spark):
    assert sessions.sessions(spark.createDataFrame([], SCHEMA), 60).count() == 0

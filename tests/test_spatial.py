import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulon.operators import spatial

SCHEMA = "id bigint, lon double, lat double"


def brute(points, centres):
    return {(p[0], c[0]) for p in points for c in centres if None not in p[1:] + c[1:] and not any(np.isnan(p[1:3])) and abs(p[2]) <= 90 and abs(p[1]) <= 180 and c[3] >= 0 and spatial.great_circle_m(p[1], p[2], c[1], c[2]) <= c[3]}


def points_of(rng, n, hot):
    out = [(i, float(rng.uniform(-1, 1)), float(rng.uniform(40, 41))) for i in range(n)]
    out += [(n + i, 0.25, 40.5) for i in range(hot)]  # one place with a third of all rows
    return out + [(-1, None, 40.5), (-2, 0.2, None), (-3, float("nan"), 40.5), (-4, 0.1, 95.0), (-5, 179.9999, 0.0), (-6, -179.9999, 0.0), (-7, 30.0, 89.99), (-8, -150.0, 89.99)]


def test_near_equals_brute_force_with_hot_places_poles_and_the_date_line(spark):
    rng = np.random.default_rng(0)
    points = points_of(rng, 300, 150)
    centres = [(i, float(rng.uniform(-1, 1)), float(rng.uniform(40, 41)), float(rng.uniform(0, 9000))) for i in range(60)]
    centres += [(100, 179.9999, 0.0, 500.0), (101, 0.0, 90.0, 2000.0), (102, 0.25, 40.5, 0.0), (103, 0.1, 40.1, -1.0), (104, 0.25, 40.5, 3000.0)]
    p = spark.createDataFrame(points, SCHEMA)
    c = spark.createDataFrame(centres, "ref_id bigint, lon double, lat double, radius_m double").withColumn("id", F.lit("clash"))
    got = [(r.id, r.ref_id) for r in spatial.near(p, c, spatial.Strips(p, 12)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(points, centres)


def test_a_hot_place_is_split(spark):
    p = spark.createDataFrame([(i, 0.25, 40.5) for i in range(1000)], SCHEMA)
    strips = spatial.Strips(p, 10)
    assert strips.plan.parts.max() >= 10
    assert strips.owned().select("part").distinct().count() > 5


def test_strip_plan_covers_every_cell_once():
    plan = spatial.strip_plan({5: 10, 7: 1000, 9: 3, 10: 4}, 4)
    assert list(plan.cell) == [5, 7, 9, 10]
    assert plan[plan.cell == 7].parts.item() >= 4


def test_near_keeps_repeats_and_clashing_columns(spark):
    p = spark.createDataFrame([(1, 0.0, 40.0, "a", 7), (1, 0.0, 40.0, "a", 7)], SCHEMA + ", strip string, ref_id int")
    c = spark.createDataFrame([(5, 0.0, 40.0, 10.0)], "ref_id bigint, lon double, lat double, radius_m double")
    got = spatial.near(p, c).collect()
    assert [(r.id, r.strip, r.ref_id_point, r.ref_id) for r in got] == [(1, "a", 7, 5)] * 2


@pytest.mark.parametrize("empty", ["points", "centres"])
def test_near_of_empty_tables(spark, empty):
    p = spark.createDataFrame([] if empty == "points" else [(1, 0.0, 40.0)], SCHEMA)
    c = spark.createDataFrame([] if empty == "centres" else [(5, 0.0, 40.0, 10.0)], "ref_id bigint, lon double, lat double, radius_m double")
    assert spatial.near(p, c).count() == 0


def test_within_pieces_holes_and_broken_boundaries(spark):
    square = "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))"
    pieces = "MULTIPOLYGON (((10 0, 11 0, 11 1, 10 1, 10 0)), ((12 0, 13 0, 13 1, 12 1, 12 0)))"
    r = spark.createDataFrame([(1, square), (2, pieces), (3, None), (4, "POLYGON EMPTY"), (5, "nonsense"), (6, "POLYGON ((3 3, 5 3, 5 5, 3 5))")], "ref_id bigint, boundary string")
    p = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 10.5, 0.5), (4, 12.5, 0.5), (5, 11.5, 0.5), (6, 3.5, 3.5), (7, None, 1.0)], SCHEMA)
    assert {(x.id, x.ref_id) for x in spatial.within(p, r).collect()} == {(1, 1), (3, 2), (4, 2), (6, 1), (6, 6)}


def test_inside_rings_matches_winding_of_random_triangles():
    rng = np.random.default_rng(1)
    for _ in range(20):
        t = rng.uniform(0, 1, (3, 2))
        ring = np.vstack([t, t[:1]])
        x, y = rng.uniform(0, 1, 200), rng.uniform(0, 1, 200)
        side = np.array([(t[(k + 1) % 3][0] - t[k][0]) * (y - t[k][1]) - (t[(k + 1) % 3][1] - t[k][1]) * (x - t[k][0]) for k in range(3)])
        want = (side > 0).all(axis=0) | (side < 0).all(axis=0)
        assert (spatial.inside_rings(x, y, [ring]) == want).all()


def test_long_wkt_is_read_whole():
    n = 5000
    a = np.linspace(0, 2 * np.pi, n, endpoint=False)
    text = "POLYGON ((" + ", ".join(f"{np.cos(v):.6f} {np.sin(v):.6f}" for v in a) + "))"
    assert len(spatial.parse_wkt(text)[0]) == n + 1
    assert isinstance(spatial.strip_plan({}, 3), pd.DataFrame)

import datetime
import glob
import math
import os
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tabulon.__main__ import main
from tabulon.sources import tables as src


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(p).split('.')[0]} as select * from '{p}'")
    return c


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    if isinstance(v, (datetime.datetime, str)):
        return str(v)
    return round(float(v), 4)


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, data, name):
    got, want = entry.queries()[name](spark, data).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["basic_schema", "infer", "relate", "stream_single_pass", "density_image", "p1_found", "p2_filled", "p4_load_percentiles", "p6_found", "p6_divergence", "p7_found"])
def test_other_queries_run(spark, data, name):
    assert entry.queries()[name](spark, data).count() > 0


def test_trip_ends_near_stands_equal_brute_force(spark, duck, data):
    want = duck.execute("""
        with e as (select trip_id, 'pickup' as trip_end, pickup_longitude as lon, pickup_latitude as lat from example union all select trip_id, 'dropoff', dropoff_longitude, dropoff_latitude from example)
        select trip_id, trip_end, stand_id from e, stands s where not isnan(lon) and 2 * 6371008.8 * asin(least(1, sqrt(sin(radians(lat - latitude) / 2) ^ 2 + cos(radians(lat)) * cos(radians(latitude)) * sin(radians(lon - longitude) / 2) ^ 2))) <= radius_m""").fetchall()
    got = entry.queries()["p1_found"](spark, data).where("match_kind = 'near'").collect()
    assert sorted((r.trip_id, r.trip_end, r.ref_id) for r in got) == sorted(want)


def test_core_imports_nothing_of_the_corpus_package():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for p in glob.glob(f"{root}/tabulon/**/*.py", recursive=True):
        if "/llm/" not in p:
            assert "llm" not in open(p).read()
    code = "import sys; sys.modules['tabulon.llm'] = None; import __spark_entry__ as e; assert not any(k.startswith('p8') for k in e.queries()) and e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "schema.csv").write_text("name,type\nk,id\nx,real\nc,categorical\nb,boolean\n")
    (tmp_path / "rows.csv").write_text("k,x,c,b\n" + "".join(f"r{i},{i % 7},{'ab'[i % 2]},{'1' if i % 5 else '0'}\n" for i in range(60)))
    (tmp_path / "new.csv").write_text("k,x,c,b\nq1,,a,\nq2,3,,1\n")
    run = lambda *a: main(["--root", str(tmp_path / "data"), *map(str, a)])
    run("ingest", "t", tmp_path / "schema.csv", tmp_path / "rows.csv")
    run("infer", "t", "--samples", 2)
    run("tare", "t")
    run("export", "t", tmp_path / "export", "--chunk", 30)
    run("related", "t", "--count", 50)
    run("predict", "t", tmp_path / "new.csv", tmp_path / "predicted", "--count", 2, "--id", "k")
    run("group", "t", "x", tmp_path / "groups")
    run("cat", "t", "ingest/encoding.json")
    assert '"b": 1' in capsys.readouterr().out
    assert src.read_csv(spark, str(tmp_path / "export")).count() == 60
    p = src.read_csv(spark, str(tmp_path / "predicted")).collect()
    assert len(p) == 4 and all(r.x and r.c and r.b for r in p) and {r.external_id for r in p} == {"q1", "q2"}
    assert src.read_csv(spark, str(tmp_path / "groups")).count() == 60
    run("clean", "t")
    with pytest.raises(FileNotFoundError):
        run("related", "t")

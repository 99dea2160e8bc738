"""Command line: python -m tabulon COMMAND ... ; see each command's --help."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tabulon.functions import crosscat as cc
from tabulon.operators import ensemble, sparsify
from tabulon.plans import encode as enc
from tabulon.plans import transforms as tr
from tabulon.sources import store as stores
from tabulon.sources import tables as src
from tabulon.streaming.single_pass import watch
from tabulon.table import PredictiveTable, matrix


def session() -> SparkSession:
    return SparkSession.builder.appName("tabulon").getOrCreate()


def load(store: stores.Store) -> PredictiveTable:
    """A data set that was ingested and learnt before."""
    spark = session()
    features = enc.from_json(store.text(store.ingest("encoding.json")))
    plan = tr.TransformPlan.from_json(store.text(store.ingest("transforms.json")))
    return PredictiveTable(spark, features, stores.load_samples(spark, store), spark.read.parquet(store.ingest("rows")), plan, spark.read.parquet(store.ingest("rowids")))


def ingest(a, store: stores.Store) -> None:
    """Transform and encode a CSV table with a fluent schema."""
    spark = session()
    raw = src.read_any(spark, a.rows)
    plan = tr.make_plan(raw, src.load_schema(a.schema))
    basic = plan.forward(src.with_row_ids(raw, plan.id_column), ["row_id", "external_id"])
    features = enc.make_encoding(basic, plan.models())
    enc.encode(basic, features).write.mode("overwrite").parquet(store.ingest("rows"))
    basic.select("row_id", "external_id").write.mode("overwrite").parquet(store.ingest("rowids"))
    store.text(store.ingest("encoding.json"), enc.to_json(features))
    store.text(store.ingest("transforms.json"), plan.to_json())


def infer(a, store: stores.Store) -> None:
    """Learn posterior samples."""
    spark = session()
    features = enc.from_json(store.text(store.ingest("encoding.json")))
    samples = ensemble.learn(spark.read.parquet(store.ingest("rows")), features, a.samples, None if a.extra_passes is None else cc.Config(extra_passes=a.extra_passes), a.learn_rows, a.passes, a.seed)
    stores.save_samples(spark, store, samples)
    print(json.dumps(ensemble.metrics(samples)))


def tare(a, store: stores.Store) -> None:
    """Print the most common values of boolean and count features, and store the rows as differences to them."""
    spark = session()
    features = enc.from_json(store.text(store.ingest("encoding.json")))
    rows = spark.read.parquet(store.ingest("rows"))
    rows = rows.select("row_id", *[F.col(f"`{f.name}`").alias(f"f{i}") for i, f in enumerate(features)])
    b = [f"f{i}" for i, f in enumerate(features) if f.model == "bb"]
    c = [f"f{i}" for i, f in enumerate(features) if f.model in ("dd", "dpd", "gp")]
    usual = sparsify.tare_dict(rows, b, c)
    sparsify.sparsify(rows, b + c, usual, ["row_id"]).write.mode("overwrite").parquet(store.ingest("diffs"))
    print(json.dumps({features[int(k[1:])].name: v for k, v in usual.items()}))


def export(a, store: stores.Store) -> None:
    """Write the encoded rows as CSV files."""
    features = enc.from_json(store.text(store.ingest("encoding.json")))
    print(src.export_rows(session().read.parquet(store.ingest("rows")), features, a.out, a.chunk), "files")


def related(a, store: stores.Store) -> None:
    """Print how columns are related."""
    print(src.to_csv_text(matrix(load(store).relate(a.columns or None, count=a.count))))


def predict(a, store: stores.Store) -> None:
    """Complete the rows of a CSV table."""
    src.write_csv(load(store).predict(a.rows, a.count, a.id), a.out)


def group(a, store: stores.Store) -> None:
    """Consensus groups of the rows for a column."""
    src.write_csv(load(store).group(a.column), a.out)


def crossvalidate(a, store: stores.Store) -> None:
    """Mean scores of held-out rows."""
    features = enc.from_json(store.text(store.ingest("encoding.json")))
    r = ensemble.held_out(session().read.parquet(store.ingest("rows")), features, a.proportion, a.seeds)
    print(r.agg(F.avg("mean_score").alias("mean"), F.stddev_pop("mean_score").alias("std")).toPandas().to_csv(index=False))


def cat(a, store: stores.Store) -> None:
    """Show a stored table or file."""
    path = store.path(a.what)
    if os.path.isfile(path):
        print(store.text(path))
    else:
        session().read.parquet(path).show(a.limit, False)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tabulon", description=__doc__)
    p.add_argument("--root", default="tabulon-data")
    sub = p.add_subparsers(required=True, dest="command")

    def command(f, *options):
        s = sub.add_parser(f.__name__, help=f.__doc__)
        s.add_argument("name")
        for flags, kw in options:
            s.add_argument(flags, **kw)
        s.set_defaults(run=f)

    command(ingest, ("schema", {}), ("rows", {}))
    command(infer, ("--samples", {"type": int, "default": 10}), ("--extra-passes", {"type": float}), ("--learn-rows", {"type": int, "default": ensemble.LEARN_ROWS}), ("--passes", {"type": int}), ("--seed", {"type": int, "default": 0}))
    command(tare)
    command(export, ("out", {}), ("--chunk", {"type": int, "default": 1_000_000}))
    command(related, ("--columns", {"nargs": "*"}), ("--count", {"type": int, "default": 1000}))
    command(predict, ("rows", {}), ("out", {}), ("--count", {"type": int, "default": 10}), ("--id", {}))
    command(group, ("column", {}), ("out", {}))
    command(crossvalidate, ("--proportion", {"type": float, "default": 0.9}), ("--seeds", {"type": int, "default": 2}))
    command(cat, ("what", {}), ("--limit", {"type": int, "default": 20}))
    w = sub.add_parser("watch", help="show the metrics log of a stream")
    w.add_argument("folder")
    w.add_argument("--style", default="brief", choices=["full", "partial", "brief"])
    c = sub.add_parser("clean", help="drop a data set")
    c.add_argument("name")
    a = p.parse_args(argv)
    if a.command == "watch":
        print("\n".join(watch(session(), a.folder, a.style)))
    elif a.command == "clean":
        stores.Store(a.root, a.name).clean()
    else:
        a.run(a, stores.Store(a.root, a.name))


if __name__ == "__main__":
    main()

"""PredictiveTable: the user's questions about a learnt table, as DataFrame operations.

relate, refine and support compare columns; predict completes rows; group, similar, search and cluster compare rows.
Columns are named as the user declared them (fluent names); a fluent column may stand for several encoded features.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce
from itertools import product
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.functions import crosscat as cc
from tabulon.operators import consensus, ensemble
from tabulon.plans import encode as enc
from tabulon.plans.schema import Feature, SchemaError
from tabulon.plans.transforms import TransformPlan, make_plan
from tabulon.runtime import parallelism
from tabulon.sources.tables import read_any, with_row_ids


class PredictiveTable:
    """A learnt table. Make one with fit(); samples, features and plan can be saved with sources.store."""

    def __init__(self, spark: SparkSession, features: list[Feature], samples: list[cc.Sample] | Callable[[], list[cc.Sample]], rows: DataFrame, plan: TransformPlan | None = None, rowids: DataFrame | None = None):
        """samples: or what learns them, which is called when they are first asked for."""
        if rowids is not None and "external_id" not in rows.columns:
            rows = rows.join(rowids.select("row_id", "external_id"), "row_id")
        self.spark, self.features, self._samples, self.rows, self.plan, self.rowids = spark, features, samples, rows, plan, rowids

    # -- making ----------------------------------------------------------------------------------------------------
    @classmethod
    def fit(cls, spark: SparkSession, source, schema: list[tuple[str, str]] | None = None, models: dict[str, str] | None = None, lazy: bool = False, **options) -> PredictiveTable:
        """Ingest and learn. schema: fluent (name, type) pairs for text cells; models: basic model per column of a typed table. lazy: learn once the samples are asked for."""
        raw = read_any(spark, source)
        plan = make_plan(raw, schema) if schema else None
        if plan:
            ids = with_row_ids(raw, plan.id_column)
            basic = plan.forward(ids, ["row_id", "external_id"])
            models = plan.models()
        elif models:
            basic = with_row_ids(raw) if "row_id" not in raw.columns else raw.withColumn("external_id", F.col("row_id").cast("string"))
        else:
            raise SchemaError("give a fluent schema or basic models")
        features = enc.make_encoding(basic, models)
        rows = enc.encode(basic, features, keep=["external_id"])
        learn = partial(ensemble.learn, rows, features, **options)
        return cls(spark, features, learn if lazy else learn(), rows, plan, basic.select("row_id", "external_id"))

    @property
    def samples(self) -> list[cc.Sample]:
        if callable(self._samples):
            self._samples = self._samples()
        return self._samples

    # -- names -----------------------------------------------------------------------------------------------------
    @property
    def feature_names(self) -> list[str]:
        return [f.name for f in self.features]

    @property
    def column_names(self) -> list[str]:
        return [s.name for s in self.plan.steps] if self.plan else self.feature_names

    @property
    def converters(self) -> dict:
        """For pandas.read_csv: empty cells of every column are None."""
        return {c: (lambda v: None if v == "" else v) for c in self.column_names}

    @property
    def rowid_map(self) -> DataFrame:
        return self.rowids

    def encode_set(self, names: list[str]) -> frozenset[str]:
        """Features that columns stand for; names of features themselves are taken too."""
        known = set(self.feature_names)
        out = set()
        for n in names:
            if n in known:
                out.add(n)
            elif self.plan and n in self.column_names:
                out |= self.plan.forward_set([n]) & known
            else:
                raise ValueError(f"unknown column {n!r}")
        if not out:
            raise ValueError("a set of columns must not be empty")
        return frozenset(out)

    def _sets(self, sets, default: list[str]) -> list[tuple[str, frozenset[str]]]:
        """Labelled, non-empty sets of features; a label is its set's first name in order."""
        given = [[s] if isinstance(s, str) else list(s) for s in (sets if sets is not None else default)]
        out = [(min(g), self.encode_set(g)) for g in given if g]
        if len(out) < len(given):
            raise ValueError("a set of columns must not be empty")
        if len({x for x, _ in out}) < len(out):
            raise ValueError("the sets of columns have the same first name")
        for i, (_, a) in enumerate(out):
            for _, b in out[:i]:
                if a & b:
                    raise ValueError("the sets of columns must not overlap")
        return out

    def encode_row(self, row: dict | list) -> dict[str, object]:
        """A row of cells as encoded values; see encode_rows()."""
        return self.encode_rows([row])[0]

    def encode_rows(self, rows: list[dict | list]) -> list[dict[str, object]]:
        """Rows of cells, by name or by position of column_names, as encoded values, in one job. Empty cells are unobserved.

        What a dictionary doesn't name is unobserved altogether, also whether an optional cell is present. A value that the
        dictionaries don't know, or that can't be read, is a ValueError that names its place.
        """
        names, given = self.column_names, []
        for row in rows:
            if not isinstance(row, dict):
                if len(row) != len(names):
                    raise ValueError(f"a row has {len(names)} cells, not {len(row)}")
                row = dict(zip(names, row))
            unknown = [c for c in row if c not in names]
            if unknown:
                raise ValueError(f"unknown columns: {', '.join(unknown)}")
            given.append(row)
        if not given:
            return []
        cells = [[None if r.get(c) in (None, "") else str(r[c]) for c in names] for r in given]
        table = self.spark.createDataFrame([(i, *c) for i, c in enumerate(cells)], ", ".join(["row_id bigint", *[f"`{c}` string" for c in names]]))
        try:
            basic = self.plan.forward(table, ["row_id"]) if self.plan else table
            got = sorted(enc.encode(basic, self.features).collect(), key=lambda r: r.row_id)
        except Exception as e:
            for i, c in enumerate(names):
                if f"bad value of {c}" in str(e):
                    raise ValueError(f"bad value at position {i}, column {c}") from e
            raise ValueError(f"bad value in row: {str(e)[:200]}") from e
        of = {n: (self.plan.forward_set([n]) if self.plan else {n}) for n in names}
        out = []
        for r, row in zip(got, given):
            d, named = r.asDict(), set().union(*[of[n] for n in row]) if row else set()
            out.append({f: d[f] if f in named else None for f in self.feature_names})
        return out

    def decode_row(self, row: dict[str, object]) -> dict[str, str | None]:
        kinds = {"bb": "boolean", "dd": "int", "dpd": "int", "gp": "bigint", "nich": "double"}
        one = self.spark.createDataFrame([tuple(row.get(f.name) for f in self.features)], ", ".join(f"`{f.name}` {kinds[f.model]}" for f in self.features))
        return self.backward(one).first().asDict()

    def backward(self, encoded: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """Encoded rows as the user's cells."""
        keep = keep or []
        if not self.plan:
            return enc.decode(encoded, self.features, keep)
        typed = []
        for f in self.features:
            c = F.col(f"`{f.name}`")
            typed.append((enc.decode_column(f) if f.model in ("dd", "dpd") else c).alias(f.name))
        return self.plan.backward(encoded.select(*keep, *typed), keep)

    def encode_table(self, source, id_column: str | None = None) -> DataFrame:
        """Query rows, encoded, with row_id and external_id."""
        raw = read_any(self.spark, source)
        for c in self.column_names:
            if c not in raw.columns:
                raw = raw.withColumn(c, F.lit(None).cast("string"))
        ids = with_row_ids(raw, id_column)
        basic = self.plan.forward(ids, ["row_id", "external_id"]) if self.plan else ids
        return enc.encode(basic, self.features, keep=["external_id"])

    # -- rows ------------------------------------------------------------------------------------------------------
    def predict(self, source, count: int = 10, id_column: str | None = None, seed: int = 0) -> DataFrame:
        """Each input row `count` times, with its unobserved cells drawn: external_id, draw, and the columns."""
        if id_column is not None and id_column in self.column_names:
            raise ValueError(f"the id column {id_column!r} is also a modelled column")
        rows = self.encode_table(source, id_column)
        return self.backward(ensemble.complete(rows, self.samples, count=count, seed=seed, keep=("external_id",)), ["external_id", "draw"])

    def score(self, source) -> DataFrame:
        return ensemble.score(self.encode_table(source), self.samples, ("external_id",)).select("external_id", "score")

    def search(self, row: dict | list, limit: int = 1000, seed: int = 0) -> DataFrame:
        """Table rows that the given row tells most about: external_id, score, highest first."""
        # rows with equal values are scored once, by the least of their ids; a row among the first `limit` has values that are among the first `limit` of these
        value = [f"__v{i}" for i in range(len(self.features))]
        each = self.rows.groupBy(*[F.col(f"`{f}`").alias(v) for f, v in zip(self.feature_names, value)]).agg(F.min("row_id").alias("row_id"))
        each = each.withColumn("__key", F.to_json(F.struct(*value))).withColumns({f: F.col(v) for f, v in zip(self.feature_names, value)})
        scored = ensemble.derivative(each.repartition(parallelism(self.spark)), self.samples, [self.encode_row(row)], seed, ("__key",))
        kinds = ", ".join(f"{v} {k}" for v, k in each.select(*value).dtypes)
        top = scored.orderBy(F.desc("score"), "row_id").limit(limit).select(F.from_json("__key", kinds).alias("__cells"), F.col("score").alias("__score")).select("__cells.*", "__score")
        same = reduce(and_, [F.col(f"`{f}`").eqNullSafe(F.col(v)) for f, v in zip(self.feature_names, value)])
        found = self.rows.join(top, same).select("row_id", "external_id", F.col("__score").alias("score")).orderBy(F.desc("score"), "row_id").limit(limit)
        return found.select("external_id", "score").orderBy(F.desc("score"), "external_id")

    def similar(self, rows: list, rows2: list | None = None, seed: int = 0) -> DataFrame:
        """Similarity of each of rows to each of rows2 (default: rows): i, j, score, in long form."""
        a = self.encode_rows(rows)
        b = a if rows2 is None else self.encode_rows(rows2)
        kinds = dict(self.rows.dtypes)
        names = self.feature_names
        target = self.spark.createDataFrame([(i, *[r[n] for n in names]) for i, r in enumerate(b)], ", ".join(["row_id bigint", *[f"`{n}` {kinds[n]}" for n in names]]))
        return ensemble.derivative(target, self.samples, a, seed).select(F.col("update").alias("i"), F.col("row_id").cast("int").alias("j"), "score")

    def group(self, column: str, seed: int = 0) -> DataFrame:
        """Consensus grouping of the table's rows by what goes with a column: external_id, group_id, confidence."""
        features = self.encode_set([column])
        feature = min(features)
        own = [(l, s.kind_of(feature)) for l, s in enumerate(self.samples)]
        a = ensemble.assign_arrays(self.rows, self.samples, own, seed, ("external_id",))
        return consensus.consensus_arrays(a, ["external_id"], seed).orderBy("group_id", F.desc("confidence"), "external_id")

    def cluster(self, rows: list, seeds: list | None = None, clusters: int | None = None, nearest: int = 10, seed: int = 0) -> pd.Series:
        """Cluster of each row: seeds are clustered spectrally by similarity, other rows join the vote of their nearest seeds.

        Default seeds are rows drawn from the model. This compares given rows; to group a table, use group().
        """
        if seeds is None:
            kinds = dict(self.rows.dtypes)
            blank = self.spark.createDataFrame([(0, *[None] * len(self.features))], ", ".join(["row_id bigint", *[f"`{f}` {kinds[f]}" for f in self.feature_names]]))
            drawn = ensemble.complete(blank, self.samples, count=max(20, 5 * (clusters or 2)), seed=seed)
            seeds = [r.asDict() for r in self.backward(drawn).collect()]
        clusters = clusters or max(1, int(np.median([max(int((k.counts > 0).sum()) for k in s.kinds) for s in self.samples])))
        n = len(seeds)
        long = self.similar(seeds, seeds, seed).toPandas()
        m = np.zeros((n, n))
        m[long.i, long.j] = long.score
        label = consensus.spectral(np.exp(np.clip((m + m.T) / 2, 0, 5)), clusters, seed)
        if seeds is rows:
            return pd.Series(label)
        near = self.similar(seeds, rows, seed).select(F.col("j").alias("row_id"), F.col("i").alias("seed_id"), "score")
        labels = self.spark.createDataFrame([(i, int(x)) for i, x in enumerate(label)], "seed_id int, label int")
        got = consensus.neighbours_vote(near, labels, nearest).toPandas().set_index("row_id").label
        return got.reindex(range(len(rows)))

    # -- columns ---------------------------------------------------------------------------------------------------
    def _pairs(self, targets, queries, condition: dict, count: int, seed: int, forget: bool) -> DataFrame:
        """target, query, relatedness for each pair of labelled sets; with forget, cells of a pair are left out of the condition."""
        both = list(product(targets, queries))
        plain, special = [], {}
        for i, ((_, a), (_, b)) in enumerate(both):
            seen = frozenset(f for f in a | b if condition.get(f) is not None)
            if forget and seen:
                special.setdefault(seen, []).append(i)
            else:
                plain.append(i)
        parts = []
        for gone, at in [(frozenset(), plain), *special.items()]:
            if not at:
                continue
            c = {f: v for f, v in condition.items() if f not in gone}
            r = ensemble.information(self.spark, self.samples, [(both[i][0][1], both[i][1][1]) for i in at], c, count, seed)
            names = self.spark.createDataFrame([(j, both[i][0][0], both[i][1][0]) for j, i in enumerate(at)], "i int, target string, query string")
            parts.append(r.join(names, "i").select("target", "query", "relatedness"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def relate(self, columns=None, rows: str = "columns", count: int = 1000, seed: int = 0) -> DataFrame:
        """Relatedness (0..1) of columns in long form: target, query, relatedness. rows='all' compares all columns with `columns`."""
        queries = self._sets(columns, self.column_names)
        targets = self._sets(None, self.column_names) if rows == "all" else queries
        return self._pairs(targets, queries, {}, count, seed, False)

    def refine(self, targets=None, queries=None, condition: dict | list | None = None, count: int = 1000, seed: int = 0) -> DataFrame:
        """Relatedness of targets and queries given what is known of a row: where to look next. Both must be unobserved in it."""
        c = self.encode_row(condition or {})
        free = [n for n in self.column_names if not any(c.get(f) is not None for f in self.encode_set([n]))]
        t, q = self._sets(targets, free), self._sets(queries, free)
        if any(c.get(f) is not None for _, s in [*t, *q] for f in s):
            raise ValueError("targets and queries must be unobserved in the condition")
        self._disjoint_or_equal(t, q)
        return self._pairs(t, q, c, count, seed, False)

    def support(self, targets=None, observed=None, condition: dict | list | None = None, count: int = 1000, seed: int = 0) -> DataFrame:
        """Relatedness of targets and observed cells given the rest of the row: what speaks for a value."""
        c = self.encode_row(condition or {})
        known = [n for n in self.column_names if any(c.get(f) is not None for f in self.encode_set([n]))]
        if not known:
            raise ValueError("the condition must have an observed cell")
        t, o = self._sets(targets, known), self._sets(observed, known)
        if any(c.get(f) is None for _, s in o for f in s if not self.plan):
            raise ValueError("observed columns must be observed in the condition")
        self._disjoint_or_equal(t, o)
        return self._pairs(t, o, c, count, seed, True)

    @staticmethod
    def _disjoint_or_equal(a, b) -> None:
        for _, x in a:
            for _, y in b:
                if x & y and x != y:
                    raise ValueError("targets and queries must be equal or not overlap")


def matrix(long: DataFrame, rows: str = "target", columns: str = "query", value: str = "relatedness") -> DataFrame:
    """A long table as a matrix, columns in order of name."""
    names = [r[0] for r in long.select(columns).distinct().orderBy(columns).collect()]
    return long.groupBy(rows).pivot(columns, names).agg(F.first(value)).orderBy(rows)


def most_related(long: DataFrame, query: str, limit: int = 30) -> DataFrame:
    """The targets most related to one query."""
    return long.where(F.col("query") == query).orderBy(F.desc("relatedness"), "target").limit(limit)


def histogram(predicted: DataFrame, batch: str, target: str) -> DataFrame:
    """Shares of a target's drawn values per batch: one column per value."""
    n = predicted.groupBy(batch, target).agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(batch)))
    return n.groupBy(batch).pivot(target).agg(F.first("share")).orderBy(batch)


def group_summary(groups: DataFrame) -> DataFrame:
    """Per group: rows, weight (sum of confidences) and its most certain row, heaviest first."""
    g = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("confidence").alias("weight"), F.min_by("external_id", F.struct(-F.col("confidence"), F.col("external_id"))).alias("example"))
    return g.orderBy(F.desc("weight"), "group_id")

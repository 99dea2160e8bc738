"""Where a named data set and its samples are kept: paths, and saving and loading models as Parquet and JSON."""

from __future__ import annotations

import json
import os
import shutil

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tabulon.functions.crosscat import Kind, Sample


class Store:
    """Paths of one data set below a root folder."""

    INGEST = ("rows", "rowids", "encoding.json", "transforms.json", "tares", "diffs")
    SAMPLE = ("model.json", "groups", "assign", "log")

    def __init__(self, root: str, name: str):
        self.root, self.name = root, name

    def path(self, *parts) -> str:
        return os.path.join(self.root, self.name, *map(str, parts))

    def ingest(self, what: str) -> str:
        if what not in self.INGEST:
            raise ValueError(f"unknown ingest output {what!r}")
        return self.path("ingest", what)

    def sample(self, index: int, what: str) -> str:
        if what not in self.SAMPLE:
            raise ValueError(f"unknown sample output {what!r}")
        return self.path("samples", f"sample.{index:06d}", what)

    def samples(self) -> list[int]:
        base = self.path("samples")
        return sorted(int(d.split(".")[1]) for d in os.listdir(base) if d.startswith("sample.")) if os.path.isdir(base) else []

    def require(self, *paths: str) -> None:
        missing = [p for p in paths if not os.path.exists(p)]
        if missing:
            raise FileNotFoundError("first make " + ", ".join(missing))

    def text(self, path: str, value: str | None = None) -> str:
        """Write value to a small file, or read it."""
        if value is not None:
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "w") as f:
                f.write(value)
            return value
        self.require(path)
        with open(path) as f:
            return f.read()

    def clean(self) -> None:
        """Drop everything kept of the data set."""
        shutil.rmtree(self.path(), ignore_errors=True)


def _plain(x):
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    if isinstance(x, np.ndarray):
        return x.tolist()
    return x.item() if isinstance(x, np.generic) else x


def model_json(s: Sample) -> str:
    """Kinds, hyperparameters and topology of a sample (no statistics)."""
    s.validate()
    kinds = [{"features": k.features, "alpha": k.alpha, "d": k.d, "groups": len(k.counts)} for k in s.kinds]
    return json.dumps({"models": s.models, "hypers": _plain(s.hypers), "kinds": kinds, "topology": list(s.topology), "rows": int(s.rows)}, sort_keys=True)


def groups_frame(spark: SparkSession, s: Sample) -> DataFrame:
    """Statistics in long form: kind, feature (empty for group sizes), grp, stat, code, value."""
    rows = []
    for k, kind in enumerate(s.kinds):
        rows += [(k, "", g, "rows", 0, float(n)) for g, n in enumerate(kind.counts)]
        for f in kind.features:
            for name, arr in kind.stats[f].items():
                rows += [(k, f, int(ix[0]), name, int(ix[1]) if len(ix) > 1 else 0, float(arr[ix])) for ix in zip(*np.nonzero(arr))]
    return spark.createDataFrame(rows, "kind int, feature string, grp int, stat string, code int, value double")


def save_samples(spark: SparkSession, store: Store, samples: list[Sample]) -> None:
    for i, s in enumerate(samples):
        store.text(store.sample(i, "model.json"), model_json(s))
        groups_frame(spark, s).coalesce(1).write.mode("overwrite").parquet(store.sample(i, "groups"))


def load_samples(spark: SparkSession, store: Store) -> list[Sample]:
    from tabulon.functions.models import MODELS

    out = []
    for i in store.samples():
        m = json.loads(store.text(store.sample(i, "model.json")))
        hypers = {f: {k: np.array(v) if isinstance(v, list) else v for k, v in h.items()} for f, h in m["hypers"].items()}
        kinds = [Kind(k["features"], k["alpha"], k["d"], np.zeros(k["groups"]), {f: MODELS[m["models"][f]].empty(hypers[f], k["groups"]) for f in k["features"]}) for k in m["kinds"]]
        for r in spark.read.parquet(store.sample(i, "groups")).collect():
            if r.stat == "rows":
                kinds[r.kind].counts[r.grp] = r.value
            else:
                a = kinds[r.kind].stats[r.feature][r.stat]
                a[(r.grp, r.code) if a.ndim > 1 else r.grp] = r.value
        out.append(Sample(m["models"], hypers, kinds, tuple(m["topology"]), m["rows"]))
        out[-1].validate()
    return out

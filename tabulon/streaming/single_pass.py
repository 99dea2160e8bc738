"""Single-pass learning from a stream: each micro-batch is put to groups, and its statistics are added to the model.

The state is the model (bounded by its groups and dictionaries), kept by the driver and saved after every batch, so that
a restarted stream goes on from the last finished batch. Rows are exchangeable, so late or reordered rows do no harm.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabulon.functions import crosscat as cc
from tabulon.functions.models import MODELS
from tabulon.operators import ensemble


def merged(old: list[cc.Sample], new: list[cc.Sample]) -> list[cc.Sample]:
    """Samples whose statistics are the sums of two with the same groups."""
    out = []
    for a, b in zip(old, new):
        kinds = []
        for x, y in zip(a.kinds, b.kinds):
            n = max(len(x.counts), len(y.counts))
            grow = lambda k, s: {f: MODELS[s.models[f]].extend(s.hypers[f], k.stats[f], n - len(k.counts)) for f in k.features}
            gx, gy = grow(x, a), grow(y, b)
            counts = [list(k.counts) + [0] * (n - len(k.counts)) for k in (x, y)]
            kinds.append(cc.Kind(x.features, x.alpha, x.d, np.array(counts[0]) + np.array(counts[1]), {f: MODELS[a.models[f]].merge(gx[f], gy[f]) for f in x.features}))
        out.append(cc.Sample(a.models, a.hypers, kinds, a.topology, a.rows + b.rows))
    return out


def opened(batch: DataFrame, samples: list[cc.Sample], seed: int, most: int = ensemble.LEARN_ROWS) -> list[cc.Sample]:
    """The samples with groups after theirs for all rows of a batch that draw a new one, at most `most` of them at a time."""
    sizes = lambda ss: [k.counts.sum() for s in ss for k in s.kinds]
    while True:
        before = sizes(samples)
        samples = ensemble.open_groups(batch, samples, seed, most=most)
        if all(b - a < most for a, b in zip(before, sizes(samples))):
            return samples
        seed += 1


class StreamLearner:
    """foreachBatch handler. samples: the start, whose rows aren't in the stream, or what learns it from the first batch; folder: where state and metrics are kept.

    The state after batch n is the one-row table <folder>/state/epoch=n, on whatever file system the folder is; a restart reads
    the last one.
    """

    def __init__(self, spark: SparkSession, samples: list[cc.Sample] | Callable[[DataFrame], list[cc.Sample]], folder: str, seed: int = 0):
        self.spark, self.folder, self.seed, self.samples, self.done = spark, folder, seed, samples, -1
        try:
            last = spark.read.parquet(f"{folder}/state").orderBy(F.desc("epoch")).first()
        except AnalysisException:  # nothing was saved yet
            last = None
        if last is not None:
            self.done, self.samples = last.epoch, [cc.Sample.from_state(s) for s in pickle.loads(last.state)]

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        """Add one batch; a batch that was added before (after a restart) is left out."""
        if epoch <= self.done or batch.isEmpty():
            return
        if callable(self.samples):
            self.samples = self.samples(batch)
        else:
            # groups are scored by the model so far and those that the batch opens; only the batch's own statistics come back
            fixed = [s.with_empty() for s in self.samples]
            self.samples = merged(fixed, ensemble.gibbs_pass(batch, opened(batch, fixed, self.seed + epoch), self.seed + epoch, renumber=False))
        self.done = epoch
        rows = [{"epoch": epoch, **m} for m in ensemble.metrics([s.with_empty() for s in self.samples])]
        self.spark.createDataFrame([(json.dumps(r),) for r in rows], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/metrics/epoch={epoch}")
        state = bytearray(pickle.dumps([s.state() for s in self.samples]))
        self.spark.createDataFrame([(state,)], "state binary").write.mode("overwrite").parquet(f"{self.folder}/state/epoch={epoch}")


def learn_stream(stream: DataFrame, learner: StreamLearner, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start learning from an encoded stream (row_id and features)."""
    w = stream.writeStream.foreachBatch(learner).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="10 seconds")).start()


def watch(spark: SparkSession, folder: str, style: str = "brief") -> list[str]:
    """Lines of the metrics log: full (JSON), partial (a line per batch and sample) or brief (the last state per sample)."""
    try:
        rows = [json.loads(r.value) for r in spark.read.text(f"{folder}/metrics").select("value").collect()]
    except AnalysisException:  # nothing was logged yet
        rows = []
    rows.sort(key=lambda r: (r["epoch"], r["sample"]))
    if style == "full":
        return [json.dumps(r, sort_keys=True) for r in rows]
    if style == "partial":
        return [f"epoch {r['epoch']} sample {r['sample']}: {r['rows']} rows, {r['kinds']} kinds, {r['groups']} groups, score {r['score']:.1f}" for r in rows]
    last = {r["sample"]: r for r in rows}
    return [f"sample {s}: {r['rows']} rows, {r['groups']} groups" for s, r in sorted(last.items())]

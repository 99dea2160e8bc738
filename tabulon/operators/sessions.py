"""Sessions of an entity's events, read off a Cartesian tree over the gaps between its consecutive events.

1. Compress. Events are grouped by entity and time chunk, so that a hot entity is spread over its chunks. Within a chunk,
   events whose gap is at most RESOLUTION seconds are merged into one segment (they're in one session for every
   threshold above). An entity then has at most (time span / RESOLUTION) segments, however many events it has.
2. Build. The segments of an entity, in order, extend a Cartesian tree (largest gap at the root) chunk after chunk along
   its right spine; the gap before a segment runs from the latest end of all that came before it. Every node knows its
   own gap, its parent's gap, and its span's start, end, events.
3. Cut. The sessions for a threshold t are the nodes with gap <= t < parent_gap: a filter on the stored tree, so one tree
   serves every threshold of at least RESOLUTION seconds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Gaps up to this many seconds never separate sessions; the smallest threshold that a tree can be cut at.
RESOLUTION = 60
#: Seconds per chunk of an entity's time line.
CHUNK = 6 * 3600
#: Parent gap of a root, and gap of nothing: no threshold reaches it.
NEVER = (1 << 62)


def segments(events: DataFrame, resolution: int = RESOLUTION, chunk: int = CHUNK, same: list[str] | None = None) -> DataFrame:
    """Merge events (entity, start_s, end_s as bigint seconds) into segments entity, start_s, end_s, events.

    same: columns that, with entity and start_s, tell that records are one event (its latest end counts). Rows without
    entity or start_s are left out; a missing end or one before the start counts as the start.
    """
    alike = [f"__same{i}" for i in range(len(same or []))]
    e = events.select("entity", F.col("start_s").cast("bigint").alias("start_s"), F.col("end_s").cast("bigint").alias("end_s"), *[F.col(c).alias(a) for c, a in zip(same or [], alike)])
    e = e.where(F.col("entity").isNotNull() & F.col("start_s").isNotNull())
    e = e.withColumn("end_s", F.greatest(F.col("start_s"), F.coalesce(F.col("end_s"), F.col("start_s")))).withColumn("chunk", F.floor(F.col("start_s") / chunk))
    if same is not None:
        # Clustered by entity and chunk first: both the merging of records and the window below reuse that shuffle.
        e = e.repartition(F.col("entity"), F.col("chunk")).groupBy("entity", "chunk", "start_s", *alike).agg(F.max("end_s").alias("end_s"))
    w = Window.partitionBy("entity", "chunk").orderBy("start_s", "end_s")
    before = F.max("end_s").over(w.rowsBetween(Window.unboundedPreceding, -1))
    e = e.withColumn("new", (F.col("start_s") > F.coalesce(before, F.lit(-NEVER)) + resolution).cast("int"))
    e = e.withColumn("segment", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("entity", "chunk", "segment").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.count(F.lit(1)).alias("events")).drop("chunk", "segment")


class TreeBuilder:
    """Online Cartesian tree of one entity. Nodes leave as soon as nothing that comes later can change them."""

    __slots__ = ("latest", "out", "spine")

    def __init__(self, out: list):
        self.out, self.spine, self.latest = out, [], None

    def add(self, start: int, end: int, events: int) -> None:
        """Append a segment. spine: open nodes [gap before the node's right part, start, end, events], root first."""
        if self.latest is None:
            self.latest = end
            self.spine.append([NEVER, start, end, events])
            return
        gap = max(0, start - self.latest)
        self.latest = max(self.latest, end)
        self.close(gap)
        self.spine.append([gap, start, end, events])

    def close(self, gap: int) -> None:
        """Join everything right of the last gap larger than this one.

        The spine's parts are separated by falling gaps. The last part's tree is complete once a larger or equal gap
        follows: it hangs below the smaller of its two neighbouring gaps.
        """
        spine, out = self.spine, self.out
        while len(spine) > 1 and spine[-1][0] <= gap:
            own, start, end, events, *inner = spine.pop()
            left = spine[-1]
            # the two children of this gap are complete, unless they were joined at the same gap before
            for child in ((left[1], left[2], left[3], *left[4:]), (start, end, events, *inner)):
                below = child[3] if len(child) > 3 else -1
                if below != own:
                    out.append((below, own, child[0], child[1], child[2]))
            left[2], left[3] = max(left[2], end), left[3] + events
            left[4:] = [own]

    def finish(self) -> None:
        self.close(NEVER)
        for _, start, end, events, *inner in self.spine:
            self.out.append((inner[0] if inner else -1, NEVER, start, end, events))


def gap_tree(segs: DataFrame) -> DataFrame:
    """The Cartesian tree over the gaps: entity, gap_s, parent_gap_s, start_s, end_s, events; leaves have gap_s -1.

    segs is what segments() returns. An entity's rows meet in one task; segments() bounds their number by time, not by
    events. An entity with no segment has no node; equal gaps become one node with several children.
    """
    kind = dict(segs.dtypes)["entity"]
    near = segs.select("entity", "start_s", "end_s", "events").repartition(F.col("entity")).sortWithinPartitions("entity", "start_s", "end_s")

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, tree, names, out = None, None, [], []

        def flush() -> pd.DataFrame:
            a = np.array(out, np.int64).reshape(-1, 5)
            return pd.DataFrame({"entity": names, "gap_s": a[:, 0], "parent_gap_s": a[:, 1], "start_s": a[:, 2], "end_s": a[:, 3], "events": a[:, 4]})

        for batch in batches:
            for entity, start, end, events in zip(batch.entity.tolist(), batch.start_s.tolist(), batch.end_s.tolist(), batch.events.tolist()):
                if tree is None or entity != current:
                    if tree is not None:
                        tree.finish()
                        names += [current] * (len(out) - len(names))
                    current, tree = entity, TreeBuilder(out)
                tree.add(start, end, events)
            names += [current] * (len(out) - len(names))
            if len(out) > 50_000:
                yield flush()
                out.clear()
                names.clear()
        if tree is not None:
            tree.finish()
            names += [current] * (len(out) - len(names))
            yield flush()

    return near.mapInPandas(build, f"entity {kind}, gap_s bigint, parent_gap_s bigint, start_s bigint, end_s bigint, events bigint")


def cut(tree: DataFrame, threshold: int | Column) -> DataFrame:
    """Sessions for one threshold: entity, start_s, end_s, duration_s, events. A gap of exactly the threshold joins."""
    t = F.lit(threshold) if isinstance(threshold, int) else threshold
    return tree.where((F.col("gap_s") <= t) & (t < F.col("parent_gap_s"))).select("entity", "start_s", "end_s", (F.col("end_s") - F.col("start_s")).alias("duration_s"), "events")


def sessions(events: DataFrame, threshold: int, same: list[str] | None = None) -> DataFrame:
    """Sessions of events (entity, start_s, end_s): a new one starts more than threshold seconds after all earlier ends.

    Nulls: rows without entity or start are left out, a missing or too early end is the start. Equal starts are ordered
    by end, which changes no session. Repeated rows are separate events unless `same` says otherwise. No rows, no
    sessions. Columns beyond those named are ignored. Thresholds below RESOLUTION build a tree of that resolution.
    """
    fine = min(RESOLUTION, threshold)
    return cut(gap_tree(segments(events, resolution=fine, same=same)), threshold)

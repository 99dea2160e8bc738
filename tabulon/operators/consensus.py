"""Consensus groupings of rows over several samples, and clustering by similarity."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.runtime import reliable_checkpoint


def overlaps(assign: DataFrame) -> DataFrame:
    """Jaccard similarity of groups of different samples that share rows: a, b, overlap, jaccard.

    assign: row_id, sample, grp (one group per row and sample). A row's groups, one per sample, are gathered and paired; pairs are combined
    on the map side, so a shuffle holds group pairs and not row pairs.
    """
    sizes = assign.groupBy("sample", "grp").agg(F.count(F.lit(1)).alias("size"))
    per = assign.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("sample", "grp"))).alias("g"))
    pair = per.select(F.explode("g").alias("a"), "g").select("a", F.explode("g").alias("b")).where("a < b")
    n = pair.groupBy("a", "b").agg(F.count(F.lit(1)).alias("overlap"))
    key = lambda x: F.struct("sample", "grp").alias(x)
    n = n.join(sizes.select(key("a"), F.col("size").alias("size_a")), "a").join(sizes.select(key("b"), F.col("size").alias("size_b")), "b")
    return n.withColumn("jaccard", F.col("overlap") / (F.col("size_a") + F.col("size_b") - F.col("overlap")))


def spectral(weights: np.ndarray, parts: int, seed: int = 0) -> np.ndarray:
    """Parts of a weighted graph: normalised spectral embedding, then k-means with the best of several seeded starts.

    Weights of nodes with themselves say nothing about parts and are left out.
    """
    n = len(weights)
    parts = max(1, min(parts, n))
    if parts == 1:
        return np.zeros(n, np.int64)
    if parts == n:
        return np.arange(n)
    w = weights + 1e-9
    np.fill_diagonal(w, 0.0)
    d = 1 / np.sqrt(w.sum(axis=1))
    _, vectors = np.linalg.eigh(w * d[:, None] * d)
    x = vectors[:, -parts:]
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    rng, best = np.random.default_rng(seed), (np.inf, np.zeros(n, np.int64))
    for _ in range(10):
        centres = [x[rng.integers(n)]]
        for _ in range(parts - 1):
            far = np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0)
            centres.append(x[rng.choice(n, p=far / far.sum())] if far.sum() > 0 else x[rng.integers(n)])
        c = np.array(centres)
        for _ in range(50):
            dist = ((x[:, None] - c) ** 2).sum(axis=2)
            label = dist.argmin(axis=1)
            new = np.array([x[label == k].mean(axis=0) if (label == k).any() else x[dist.min(axis=1).argmax()] for k in range(parts)])
            if np.allclose(new, c):
                break
            c = new
        best = min(best, (dist.min(axis=1).sum(), label), key=lambda t: t[0])
    return best[1]


def consensus(assign: DataFrame, seed: int = 0) -> DataFrame:
    """row_id, group_id, confidence: consensus_arrays() of rows (row_id, sample, grp), one per row and sample."""
    per = assign.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("sample", "grp"))).alias("g"))
    found = consensus_arrays(per.select("row_id", F.transform("g", lambda x: x.grp).alias("groups")), ["row_id"], seed)
    return found.orderBy("group_id", F.desc("confidence"), "row_id")


def consensus_arrays(rows: DataFrame, keep: list[str], seed: int = 0) -> DataFrame:
    """The columns of keep, group_id, confidence: one grouping of the rows that agrees with all samples, by clustering their groups.

    rows: keep, groups (a row's group in each sample). Rows are counted by pairs of groups of two samples, on the map side first: what is shuffled
    and kept by the driver is a row per pair of groups that share rows. The groups are a graph with Jaccard weights; it is cut into as many parts
    as a sample has groups in the median. A row belongs to the part that most of its groups are in (the smaller part on ties); confidence is
    that share. The parts of a row are looked up in its own groups; no row is shuffled. Parts are numbered by falling size.
    """
    rows = reliable_checkpoint(rows)  # used three times below: a few small numbers per row, and a scoring pass to make
    each = F.transform("groups", lambda g, i: F.struct(i.alias("sample"), g.alias("grp")))
    one = rows.select(F.explode(each).alias("a"), "groups")
    pair = one.select("a", F.explode(F.filter(F.transform("groups", lambda g, i: F.struct(i.alias("sample"), g.alias("grp"))), lambda b: b.sample >= F.col("a.sample"))).alias("b"))
    n = pair.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).collect()  # squares of the model's groups at most
    sizes = {tuple(r.a): r.n for r in n if r.a == r.b}
    groups = sorted(sizes)
    at = {g: i for i, g in enumerate(groups)}
    w = np.eye(len(groups))
    for r in n:
        i, j = at[tuple(r.a)], at[tuple(r.b)]
        w[i, j] = w[j, i] = r.n / (sizes[tuple(r.a)] + sizes[tuple(r.b)] - r.n)
    samples = sorted({s for s, _ in groups})
    k = int(np.median([sum(1 for s, _ in groups if s == x) for x in samples])) if samples else 1
    part = spectral(w, k, seed) if len(samples) > 1 else np.arange(len(groups))
    if not groups:
        return rows.select(*keep, F.lit(0).cast("long").alias("group_id"), F.lit(1.0).alias("confidence"))
    # part of each sample's groups, as arrays in the plan
    table = [[0] * (1 + max(g for s, g in groups if s == x)) for x in samples]
    for (s, g), i in at.items():
        table[s][g] = int(part[i])
    literal = F.expr("array(" + ", ".join("array(" + ", ".join(map(str, t)) + ")" for t in table) + ")")
    own = rows.select(*keep, F.transform("groups", lambda g, i: F.get(F.get(literal, i), g)).alias("__parts"))
    votes = F.transform(F.array_distinct("__parts"), lambda p: F.struct(F.size(F.filter("__parts", lambda q: q == p)).alias("votes"), (-p).alias("part")))
    best = own.select(*keep, F.array_max(votes).alias("__best")).select(*keep, (-F.col("__best.part")).alias("part"), (F.col("__best.votes") / len(samples)).alias("confidence"))
    order = {r.part: i for i, r in enumerate(best.groupBy("part").count().orderBy(F.desc("count"), "part").collect())}
    places = F.expr("array(" + ", ".join(f"{order.get(p, -1)}L" for p in range(int(part.max()) + 1)) + ")")
    return best.select(*keep, F.get(places, F.col("part")).alias("group_id"), "confidence")


def vote(parts: DataFrame, samples: int) -> DataFrame:
    """Majority part per row, renumbered by size. parts: row_id, part (one row per sample)."""
    n = parts.groupBy("row_id", "part").agg((F.count(F.lit(1)) / samples).alias("confidence"))
    best = n.groupBy("row_id").agg(F.max(F.struct("confidence", (-F.col("part")).alias("neg"))).alias("m")).select("row_id", (-F.col("m.neg")).alias("part"), F.col("m.confidence").alias("confidence"))
    sizes = best.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    rank = sizes.select("part", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("size"), "part")) - 1).alias("group_id"))
    return best.join(F.broadcast(rank), "part").select("row_id", "group_id", "confidence").orderBy("group_id", F.desc("confidence"), "row_id")


def size_ranks(assign: DataFrame) -> DataFrame:
    """sample, kind, grp, size, new_id: groups renumbered by falling size within sample and kind, ties by old number."""
    n = assign.groupBy("sample", "kind", "grp").agg(F.count(F.lit(1)).alias("size"))
    return n.withColumn("new_id", F.row_number().over(Window.partitionBy("sample", "kind").orderBy(F.desc("size"), "grp")) - 1)


def neighbours_vote(similar: DataFrame, labels: DataFrame, k: int = 10) -> DataFrame:
    """k-nearest-neighbour vote: row_id, label. similar: row_id, seed_id, score; labels: seed_id, label.

    Ties between labels go to the smaller one, ties between neighbours to the smaller seed_id.
    """
    top = F.row_number().over(Window.partitionBy("row_id").orderBy(F.desc("score"), "seed_id"))
    near = similar.withColumn("place", top).where(F.col("place") <= k).join(labels, "seed_id")
    n = near.groupBy("row_id", "label").agg(F.count(F.lit(1)).alias("votes"))
    return n.groupBy("row_id").agg(F.max_by("label", F.struct("votes", -F.col("label"))).alias("label"))

"""Mixing sources to target weights by Pareto order sampling, with sizes in tokens.

The total is the largest that every source with documents can serve: no source gives more than max_repeats times its
size. A source needs c = weight * total / size copies of itself on average. Each document gets floor(c) certain copies;
the rest is an order sample: documents are ranked by their random odds divided by the odds of their inclusion, and the
first ones are taken until the source's tokens are met. The cut is found from a histogram of the ranks (at most BINS sums
per source) and a sort of one bin, so no source, however large, is ever sorted whole. Draws depend on the document's id
and the seed alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.runtime import hash_unit

BINS = 1 << 14


def source_name(c: Column | str) -> Column:
    """A source as it is compared: lower case, without outer blanks, underscores for blanks and hyphens; blank is null."""
    c = F.col(c) if isinstance(c, str) else c
    c = F.regexp_replace(F.lower(F.trim(c)), r"[\s\-_]+", "_")
    return F.when(c != "", c)


def plan(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """What each source with a target gives: source, weight, max_repeats, docs, size, target_share, goal (tokens), copies, whole, part.

    sizes: source, size. Repeated targets of a source add up (the smallest max_repeats counts); targets without a positive
    weight are none. target_share is the weight as a share of all weights. A source without documents gives nothing: its goal is 0 and the
    others keep their proportions. total: tokens to reach at most; default is the largest feasible.
    """
    t = targets.select(source_name("source").alias("source"), F.col("weight").cast("double").alias("weight"), F.col("max_repeats").cast("int").alias("max_repeats"))
    t = t.where("source is not null and weight > 0 and not isnan(weight)").groupBy("source").agg(F.sum("weight").alias("weight"), F.coalesce(F.min("max_repeats"), F.lit(1)).alias("max_repeats"))
    s = sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("docs"))
    p = t.join(s, "source", "left").withColumn("size", F.coalesce("size", F.lit(0))).withColumn("docs", F.coalesce("docs", F.lit(0)))
    every = Window.partitionBy(F.lit(0))  # one row per source of the targets
    able = F.when((F.col("size") > 0) & (F.col("max_repeats") > 0), F.col("max_repeats") * F.col("size") / F.col("weight"))
    p = p.withColumn("target_share", F.col("weight") / F.sum("weight").over(every)).withColumn("most", F.min(able).over(every))
    most = F.least(F.col("most"), F.try_divide(F.lit(float(total)), F.sum(F.when(able.isNotNull(), F.col("weight"))).over(every))) if total is not None else F.col("most")
    p = p.withColumn("goal", F.when(able.isNotNull(), F.col("weight") * most).otherwise(0.0))
    p = p.withColumn("copies", F.coalesce(F.try_divide("goal", "size"), F.lit(0.0)))
    whole = F.floor(F.col("copies") + 1e-9)
    return p.withColumn("whole", whole).withColumn("part", F.greatest(F.lit(0.0), F.col("copies") - whole)).drop("most")


def mix(sizes: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 5, favour: str | None = None) -> DataFrame:
    """Documents of the mixture: doc_id, source, size, copies (at least 1).

    sizes: doc_id, source (as source_name() gives it), size. favour: a positive column of sizes that inclusion odds are in
    proportion to (default: all alike). Documents of size 0 or without a target source are left out. Rows with equal ids share one
    draw and are ordered by size. Other columns are ignored. No target or no document: no rows.
    """
    extra = [F.col(favour).cast("double").alias("__favour")] if favour else []
    d = sizes.select("doc_id", "source", F.col("size").cast("bigint").alias("size"), *extra).where("size > 0 and source is not null")
    p = plan(d, targets, total)
    part = p.where("goal > 0").select("source", "whole", "part", (F.col("goal") - F.col("whole") * F.col("size")).alias("rest"))
    # the plan has one row per target; the join is on the source alone
    j = d.join(F.broadcast(part), "source")
    u = hash_unit(F.col("doc_id"), seed=seed)
    incl = F.col("part")
    if favour:
        mean = d.groupBy("source").agg(F.avg("__favour").alias("__mean"))
        j = j.join(mean, "source")
        incl = F.least(F.lit(1 - 1e-9), F.col("part") * F.col("__favour") / F.col("__mean"))
    incl = F.greatest(incl, F.lit(1e-12))
    j = j.withColumn("rank", (u / (1 - u)) / (incl / (1 - incl)))
    j = j.withColumn("bin", F.floor(F.col("rank") / (1 + F.col("rank")) * BINS).cast("int"))
    bins = j.where("part > 0").groupBy("source", "bin").agg(F.sum("size").alias("tokens"), F.first("rest").alias("rest"))
    w = Window.partitionBy("source").orderBy("bin")
    bins = bins.withColumn("before", F.sum("tokens").over(w) - F.col("tokens"))
    edge = bins.where("before < rest and before + tokens >= rest").select("source", F.col("bin").alias("edge"), (F.col("rest") - F.col("before")).alias("left"))
    j = j.join(F.broadcast(edge), "source", "left")
    # only the documents of the bin that holds the cut are sorted: one in BINS
    inside = Window.partitionBy("source").orderBy("rank", "doc_id", "size")
    at_edge = j.where("bin = edge").withColumn("run", F.sum("size").over(inside)).withColumn("extra", (F.col("run") - F.col("size") / 2 <= F.col("left")).cast("int"))
    others = j.where("edge is null or bin != edge").withColumn("extra", F.coalesce((F.col("part") > 0) & ((F.col("bin") < F.col("edge")) | F.col("edge").isNull() & (F.col("rest") > 0)), F.lit(False)).cast("int"))
    both = others.select("doc_id", "source", "size", "whole", "extra").unionByName(at_edge.select("doc_id", "source", "size", "whole", "extra"))
    return both.withColumn("copies", (F.col("whole") + F.col("extra")).cast("int")).where("copies > 0").select("doc_id", "source", "size", "copies")


def shares(mixed: DataFrame, sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """What was reached: source, weight, target_share, max_repeats, docs, docs_used, most_copies, tokens, actual_share."""
    p = plan(sizes.where("size > 0 and source is not null"), targets, total)
    m = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("docs_used"), F.max("copies").alias("most_copies"), F.sum(F.col("size") * F.col("copies")).alias("tokens"))
    r = p.join(m, "source", "left").na.fill(0, ["docs_used", "most_copies", "tokens"])
    share = F.try_divide(F.col("tokens").cast("double"), F.sum("tokens").over(Window.partitionBy(F.lit(0))).cast("double"))
    return r.select("source", "weight", "target_share", "max_repeats", "docs", "docs_used", "most_copies", "tokens", share.alias("actual_share"))

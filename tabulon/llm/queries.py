"""The queries p8 to p10 over documents, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import abuse, mixing, tokenize
from tabulon.runtime import Query, reliable_checkpoint, table


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode(table(spark, d, "documents"), keep=["doc_id"])


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose decoded ids are their text again."""
    docs = table(spark, d, "documents").select("doc_id", "text", F.col("text").alias("whole"))
    back = tokenize.decode(tokenize.encode(docs, keep=["doc_id", "whole"]), text="back")
    return back.select("doc_id", (F.col("back") == F.coalesce("whole", F.lit(""))).alias("same"))


def sized(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", mixing.source_name("source").alias("source"), "text")
    return reliable_checkpoint(tokenize.count_tokens(docs, count="size"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mixture: which document, how often. Within a source, what isn't a whole copy is drawn with odds in proportion to size."""
    return mixing.mix(sized(spark, d), table(spark, d, "mix_targets"), favour="size").withColumnRenamed("size", "n_tokens")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares reached per source."""
    sizes, targets = sized(spark, d), table(spark, d, "mix_targets")
    return mixing.shares(mixing.mix(sizes, targets, favour="size"), sizes, targets)


def scored(spark: SparkSession, d: str) -> tuple[DataFrame, float, abuse.Trained]:
    """doc_id, source, score and passages of all documents, the cutoff, and what was learnt."""
    docs = table(spark, d, "documents")
    t = abuse.train(docs, table(spark, d, "doc_labels"))
    s = reliable_checkpoint(abuse.score(docs.select("doc_id", "source", "text"), t.reader, t.machine))
    return s, t.cutoff(s), t


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    s, cut, _ = scored(spark, d)
    return s.where(F.col("score") > cut).select("doc_id")


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d)[0].select("doc_id", F.round("score", 4).alias("score"), "passages")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    """Documents, flagged documents and their rate per source."""
    s, cut, _ = scored(spark, d)
    flag = F.coalesce((F.col("score") > cut).cast("int"), F.lit(0))
    g = s.groupBy(mixing.source_name("source").alias("source")).agg(F.count(F.lit(1)).alias("docs"), F.sum(flag).alias("flagged"))
    return g.withColumn("rate", tokenize.rate(F.col("flagged"), F.col("docs")))


def p10_held_out(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents, scored by a machine of the other half of them, against their labels, of which annotators got some wrong."""
    _, cut, t = scored(spark, d)
    hit, bad = t.held_out > cut, t.y > 0.5
    row = (cut, len(bad), int(bad.sum()), int(hit.sum()), int((hit & bad).sum()))
    return spark.createDataFrame([row], "cutoff double, labelled bigint, abusive bigint, flagged bigint, both bigint")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p8_ids, p8_round_trip, p9_mix, p9_shares, p10_found, p10_scores, p10_rates, p10_held_out)}


def oracle_sql() -> dict[str, str]:
    return {"p8_round_trip": "SELECT doc_id, true AS same FROM documents"}

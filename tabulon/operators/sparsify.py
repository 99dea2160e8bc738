"""Most common rows and differences to them, for sparse wide tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Only small counts can be a column's usual value.
COUNT_BELOW = 16


def column_modes(df: DataFrame, booleans: list[str], counts: list[str]) -> DataFrame:
    """Per column its most frequent value and how often it stands there: column_name, value (bigint), n, rows.

    Booleans: ties are false. Counts: only values below COUNT_BELOW, ties are the smallest. One aggregation over the table.
    """
    aggs: list[Column] = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(booleans):
        aggs += [F.coalesce(F.sum(F.col(c).cast("bigint")), F.lit(0)).alias(f"t{i}"), F.coalesce(F.sum((~F.col(c)).cast("bigint")), F.lit(0)).alias(f"f{i}")]
    for i, c in enumerate(counts):
        aggs += [F.coalesce(F.sum((F.col(c) == v).cast("bigint")), F.lit(0)).alias(f"c{i}_{v}") for v in range(COUNT_BELOW)]
    one = df.agg(*aggs)
    each = [F.struct(F.lit(c).alias("column_name"), (F.col(f"t{i}") > F.col(f"f{i}")).cast("bigint").alias("value"), F.greatest(f"t{i}", f"f{i}").alias("n")) for i, c in enumerate(booleans)]
    for i, c in enumerate(counts):
        best = F.array_max(F.array(*[F.struct(F.col(f"c{i}_{v}").alias("n"), F.lit(-v).cast("bigint").alias("neg")) for v in range(COUNT_BELOW)]))
        each.append(F.struct(F.lit(c).alias("column_name"), (-best["neg"]).alias("value"), best["n"].alias("n")))
    return one.select("rows", F.inline(F.array(*each))).select("column_name", "value", "n", "rows")


def tare(df: DataFrame, booleans: list[str], counts: list[str], share: float = 0.5) -> DataFrame:
    """The usual row: columns whose most frequent value stands in more than `share` of all rows. Reals have none."""
    return column_modes(df, booleans, counts).where(F.col("n") > share * F.col("rows")).select("column_name", "value")


def tare_dict(df: DataFrame, booleans: list[str], counts: list[str]) -> dict[str, int]:
    """tare() as a dictionary: one value per column at most."""
    return {r.column_name: r.value for r in tare(df, booleans, counts).collect()}


def sparsify(df: DataFrame, columns: list[str], usual: dict[str, int], keep: list[str]) -> DataFrame:
    """Rows as differences: keep, and per column <c>_pos (what the row has beyond the usual) and <c>_neg (usual values it lacks).

    A cell equal to the usual one has neither. A column without usual value has only _pos.
    """
    out: list[Column] = []
    for c in columns:
        v = F.col(c).cast("bigint")
        if c in usual:
            u = F.lit(usual[c]).cast("bigint")
            differs = v.isNull() | (v != u)
            out += [F.when(v.isNotNull() & differs, v).alias(f"{c}_pos"), F.when(differs, u).alias(f"{c}_neg")]
        else:
            out += [v.alias(f"{c}_pos"), F.lit(None).cast("bigint").alias(f"{c}_neg")]
    return df.select(*keep, *out)


def restore(diffs: DataFrame, columns: list[str], usual: dict[str, int], keep: list[str]) -> DataFrame:
    """The inverse of sparsify(): usual plus pos minus neg."""
    out = []
    for c in columns:
        u = F.lit(usual[c]).cast("bigint") if c in usual else F.lit(None).cast("bigint")
        out.append(F.coalesce(F.col(f"{c}_pos"), F.when(F.col(f"{c}_neg").isNull(), u)).alias(c))
    return diffs.select(*keep, *out)

"""Dictionary encoding of basic features, row ids, and the encoded table.

Codes of a categorical feature are the ranks of its values by falling count, then value. The encoded table has row_id
and one typed column per feature: boolean (bb), int codes (dd, dpd), bigint (gp), double (nich); null is unobserved.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.plans.schema import DD_LIMIT, FALSEY, OTHER, TRUTHY, Feature, SchemaError, canonical, check_columns, check_models


def symbol_codes(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, symbol, n, code for several columns in one pass. Unobserved cells have no symbol."""
    each = F.array(*[F.struct(F.lit(c).alias("feature"), F.trim(F.col(f"`{c}`").cast("string")).alias("symbol")) for c in columns])
    n = df.select(F.inline(each)).where("symbol is not null and symbol != ''").groupBy("feature", "symbol").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("code", F.row_number().over(Window.partitionBy("feature").orderBy(F.desc("n"), "symbol")) - 1)


def make_encoding(df: DataFrame, models: dict[str, str], most_symbols: int = 100_000) -> list[Feature]:
    """Features with dictionaries, in canonical order. A dd feature of more than DD_LIMIT values is an error.

    A dpd feature keeps its most_symbols most frequent values (they are broadcast later); rarer ones are OTHER.
    """
    check_models(models)
    check_columns(list(models), df.columns)
    cats = [f for f, m in models.items() if m in ("dd", "dpd")]
    symbols: dict[str, dict[str, int]] = {f: {} for f in models}
    if cats:
        for r in symbol_codes(df, cats).where(F.col("code") < most_symbols).orderBy("feature", "code").collect():
            symbols[r.feature][r.symbol] = r.code
    for f in cats:
        if models[f] == "dd" and len(symbols[f]) > DD_LIMIT:
            raise SchemaError(f"{f!r} has {len(symbols[f])} values; a categorical has at most {DD_LIMIT}, use unbounded_categorical")
        if models[f] == "dpd":
            if OTHER in symbols[f]:
                raise SchemaError(f"{f!r} has a value {OTHER!r}, which is reserved")
            symbols[f][OTHER] = len(symbols[f])
    return canonical([Feature(f, m, symbols[f]) for f, m in models.items()])


#: Types of columns that numbers of a model are taken from as they are.
PLAIN = {"gp": ("tinyint", "smallint", "int", "bigint"), "nich": ("tinyint", "smallint", "int", "bigint", "double")}


def encode_column(f: Feature, kind: str = "string") -> Column:
    """The encoded form of one feature's column of a type. An unknown dd value is an error, an unknown dpd value OTHER."""
    raw = F.col(f"`{f.name}`")
    if kind in PLAIN.get(f.model, ()):
        return raw.cast("bigint" if f.model == "gp" else "double")
    text = F.trim(raw.cast("string"))
    text = F.when(text != "", text)
    if f.model == "bb":
        bad = F.raise_error(F.concat(F.lit(f"bad value of {f.name}: "), text)).cast("boolean")
        return F.when(text.isNull(), None).when(text.isin(*TRUTHY, "TRUE"), True).when(text.isin(*FALSEY, "FALSE"), False).otherwise(bad)
    if f.model in ("dd", "dpd"):
        if not f.symbols:
            return F.lit(None).cast("int")
        table = F.create_map(*[F.lit(x) for kv in f.symbols.items() for x in kv])
        code = F.try_element_at(table, text)
        other = F.lit(f.symbols[OTHER]) if f.model == "dpd" else F.raise_error(F.concat(F.lit(f"bad value of {f.name}: "), text)).cast("int")
        return F.when(text.isNull(), None).otherwise(F.coalesce(code, other)).cast("int")
    return text.cast("bigint" if f.model == "gp" else "double")


#: Dictionaries up to this size are literals in the plan; larger ones are joined.
LITERAL_SYMBOLS = 300


def encode(df: DataFrame, features: list[Feature], row_id: str = "row_id", keep: list[str] | None = None) -> DataFrame:
    """row_id, kept columns and the encoded features.

    Large dictionaries are joined: they have at most most_symbols rows each, and Spark sizes the join.
    """
    big = [f for f in features if f.model in ("dd", "dpd") and len(f.symbols) > LITERAL_SYMBOLS]
    out = df
    for i, f in enumerate(big):
        table = df.sparkSession.createDataFrame([(s, c) for s, c in f.symbols.items()], f"__s{i} string, __c{i} int")
        out = out.join(table, F.trim(F.col(f"`{f.name}`").cast("string")) == F.col(f"__s{i}"), "left")
    kinds, picks = dict(df.dtypes), []
    for f in features:
        if f in big:
            i = big.index(f)
            text = F.trim(F.col(f"`{f.name}`").cast("string"))
            other = F.lit(f.symbols[OTHER]) if f.model == "dpd" else F.raise_error(F.concat(F.lit(f"bad value of {f.name}: "), text)).cast("int")
            picks.append(F.when(text.isNull() | (text == ""), None).otherwise(F.coalesce(F.col(f"__c{i}"), other)).cast("int").alias(f.name))
        else:
            picks.append(encode_column(f, kinds.get(f.name, "string")).alias(f.name))
    return out.select(F.col(f"`{row_id}`").cast("bigint").alias("row_id"), *[F.col(f"`{k}`") for k in keep or [] if k != "row_id"], *picks)


def decode_column(f: Feature) -> Column:
    """Codes back to text: booleans as 1 and 0, unobserved as null."""
    c = F.col(f"`{f.name}`")
    if f.model == "bb":
        return F.when(c, "1").when(~c, "0")
    if f.model in ("dd", "dpd"):
        names = [s for s, _ in sorted(f.symbols.items(), key=lambda x: x[1])]
        return F.get(F.array(*map(F.lit, names)), c.cast("int")) if names else F.lit(None).cast("string")
    return c.cast("string")


def decode(df: DataFrame, features: list[Feature], keep: list[str] | None = None) -> DataFrame:
    return df.select(*[F.col(f"`{k}`") for k in keep or []], *[decode_column(f).alias(f.name) for f in features])


def interleaved_ids(df: DataFrame, part: str, order: list[str], parts: int, offset: int = 0) -> DataFrame:
    """row_id = offset + part + parts * (place within its part): ids of several files that interleave without gaps in between.

    part: an integer column from 0 to parts - 1. One part is one window, so parts should be files, not tables.
    """
    place = F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1
    return df.withColumn("row_id", (F.lit(offset) + F.col(part) + F.lit(parts) * place).cast("bigint"))


def dense_ids(df: DataFrame) -> DataFrame:
    """row_id without gaps or a sort: places within partitions plus the partitions' offsets (one count per partition)."""
    tagged = df.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id())
    counts = sorted((r["__p"], r["n"]) for r in tagged.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).collect())
    start, table = 0, {}
    for p, n in counts:
        table[p], start = start, start + n
    if not table:
        return df.withColumn("row_id", F.lit(0).cast("bigint"))
    offsets = F.array(*[F.lit(table.get(p, 0)).cast("bigint") for p in range(max(table) + 1)])
    return tagged.withColumn("row_id", F.get(offsets, F.col("__p")) + F.col("__i").bitwiseAND(F.lit((1 << 33) - 1))).drop("__p", "__i")


def long_form(df: DataFrame, features: list[Feature], ids: list[str]) -> DataFrame:
    """Observed cells only: ids, feature, value (double)."""
    each = F.array(*[F.struct(F.lit(f.name).alias("feature"), F.col(f"`{f.name}`").cast("double").alias("value")) for f in features])
    return df.select(*ids, F.inline(each)).where("value is not null")


def to_json(features: list[Feature]) -> str:
    return json.dumps([{"name": f.name, "model": f.model, **({"symbols": f.symbols} if f.symbols else {})} for f in features], sort_keys=True)


def from_json(text: str) -> list[Feature]:
    return [Feature(d["name"], d["model"], d.get("symbols", {})) for d in json.loads(text)]


def random_split(df: DataFrame, key: str, train: int, seed: int = 0) -> DataFrame:
    """Add `train`: true for exactly so many rows, those with the smallest seeded hashes of their keys.

    The cut is found from a histogram of the hashes and a sort of one bin, not from a sort of the table.
    """
    bins = 1 << 12
    h = df.withColumn("__h", F.xxhash64(F.lit(seed), F.col(key))).withColumn("__b", F.shiftrightunsigned("__h", 52).cast("int"))
    counts = sorted((r["__b"], r["n"]) for r in h.groupBy("__b").agg(F.count(F.lit(1)).alias("n")).collect())
    left, cut = train, bins
    for b, n in counts:
        if n > left:
            cut = b
            break
        left -= n
    inside = F.row_number().over(Window.partitionBy("__b").orderBy("__h", key)) <= left
    edge = h.where(F.col("__b") == cut).withColumn("train", inside)
    rest = h.where(F.col("__b") != cut).withColumn("train", F.col("__b") < cut)
    return edge.unionByName(rest).drop("__h", "__b")


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Rows in seeded random order, the same for every partitioning."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))

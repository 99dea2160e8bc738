"""Reading and writing tables: CSV files and folders (plain, gzip, bzip2), Parquet, pandas, bags of words."""

from __future__ import annotations

import csv
import glob
import gzip
import io
import json
import os
from bz2 import open as bz2_open

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.plans.encode import decode, dense_ids
from tabulon.plans.schema import Feature, SchemaError


def header(path: str) -> list[str]:
    """Column names of a CSV file, or of the first file of a folder; all files must agree."""
    files = [path] if os.path.isfile(path) else sorted(p for p in glob.glob(f"{path}/*") if ".csv" in os.path.basename(p))
    if not files:
        raise SchemaError(f"no CSV file at {path}")
    heads = []
    for p in files:
        op = gzip.open if p.endswith(".gz") else bz2_open if p.endswith(".bz2") else open
        with op(p, "rt", newline="") as f:
            heads.append(next(csv.reader(f), []))
    if any(h != heads[0] for h in heads):
        raise SchemaError("the headers of the files differ")
    if len(set(heads[0])) < len(heads[0]):
        raise SchemaError("repeated columns: " + ", ".join(sorted({c for c in heads[0] if heads[0].count(c) > 1})))
    return heads[0]


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file or folder, all cells text, empty cells null. Rows that are too short or too long are an error when read."""
    names = header(path)
    schema = ", ".join(f"`{n}` string" for n in names)
    return spark.read.csv(path, header=True, schema=schema, mode="FAILFAST", nullValue="", multiLine=False, enforceSchema=False)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, emptyValue="", nullValue="")


def from_rows(spark: SparkSession, names: list[str], rows: list[list[str | None]]) -> DataFrame:
    """A small table of cells; empty strings are unobserved."""
    return spark.createDataFrame([[v if v != "" else None for v in r] for r in rows], ", ".join(f"`{n}` string" for n in names))


def read_any(spark: SparkSession, source) -> DataFrame:
    """A DataFrame, pandas frame, CSV text handle, or path of CSV or Parquet."""
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, pd.DataFrame):
        return spark.createDataFrame(source.astype(object).where(source.notna(), None))
    if hasattr(source, "read"):
        rows = list(csv.reader(source))
        return from_rows(spark, rows[0], rows[1:])
    path = str(source)
    return spark.read.parquet(path) if "parquet" in path else read_csv(spark, path)


def to_csv_text(df: DataFrame) -> str:
    """A (small) result as CSV text."""
    out = io.StringIO()
    df.toPandas().to_csv(out, index=False)
    return out.getvalue()


def export_rows(encoded: DataFrame, features: list[Feature], path: str, chunk: int = 1_000_000) -> int:
    """Decoded rows as CSV files of at most about `chunk` rows, column _id first; returns the number of files."""
    n = max(1, -(-encoded.count() // chunk))
    out = decode(encoded.withColumn("_id", F.col("row_id")), features, ["_id"]).repartition(n)
    out.write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")
    return n


def chunk_count(rows: int, chunk: int = 1_000_000) -> int:
    return max(1, -(-rows // chunk))


def force_ascii(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns without their characters beyond ASCII."""
    return df.withColumns({c: F.regexp_replace(c, r"[^\x00-\x7f]+", "") for c in columns})


def repartition_csv(spark: SparkSession, path: str, out: str, parts: int = 100) -> None:
    """The rows of a CSV folder dealt evenly to so many files."""
    write_csv(read_csv(spark, path).repartition(parts), out)


def with_row_ids(df: DataFrame, id_column: str | None = None) -> DataFrame:
    """Add row_id (dense) and external_id: the id column, or file name and row_id."""
    d = dense_ids(df.withColumn("__file", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)))
    ext = F.col(f"`{id_column}`").cast("string") if id_column else F.concat_ws(":", "__file", "row_id")
    return d.withColumn("external_id", ext).drop("__file")


def bag_of_words(triples: DataFrame, doc: str = "doc", word: str = "word") -> DataFrame:
    """doc and its set of words, from (doc, word, count) rows; words with count 0 are none."""
    return triples.where("count > 0").groupBy(doc).agg(F.sort_array(F.collect_set(word)).alias("words"))


def load_json(path: str):
    with open(path) as f:
        return json.load(f)


def dump_json(value, path: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w") as f:
        json.dump(value, f, indent=1, sort_keys=True)


def load_schema(path: str) -> list[tuple[str, str]]:
    """A fluent schema: a CSV file whose header is ignored, with name and type by position."""
    with open(path, newline="") as f:
        rows = list(csv.reader(f))[1:]
    return [(r[0], r[1] if len(r) > 1 else "") for r in rows if r]

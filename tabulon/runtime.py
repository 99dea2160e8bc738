"""Session-level helpers shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Written forms (lower case, outer blanks and punctuation removed) that carry no information.
NO_VALUE_WORDS = (
    "", "unknown", "unk", "not available", "n/a", "na", "none", "null", "nil", "nan", "missing", "not known", "undefined", "blank", "no value", "not recorded",
)


def parallelism(spark: SparkSession) -> int:
    """Partitions for an explicit repartition: the session's shuffle partitions, at least two per core."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism)


def working_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; on one machine where it is unset, one that is removed at exit.

    On a cluster, where other machines couldn't see such a folder, the setting must be there.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _FOLDERS:
        _FOLDERS[sc.applicationId] = tempfile.mkdtemp(prefix="tabulon-")
        atexit.register(shutil.rmtree, _FOLDERS[sc.applicationId], True)
    return _FOLDERS[sc.applicationId]


_FOLDERS: dict[str, str] = {}


def reliable_checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage of df with a checkpoint in the working folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(working_folder(df.sparkSession))
    return df.checkpoint(eager)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the working folder, which all executors see."""
    return f"{working_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clean_key(c: Column | str) -> Column:
    """An id or name as it is compared: without outer blanks, in upper case; blank counts as missing."""
    c = F.upper(F.trim(F.col(c) if isinstance(c, str) else c))
    return F.when(c != "", c)


def clean_name(c: Column | str) -> Column:
    """A name as it is compared: without outer blanks, in lower case; blank counts as missing."""
    c = F.lower(F.trim(F.col(c) if isinstance(c, str) else c))
    return F.when(c != "", c)


def no_value(c: Column, field: str = "") -> Column:
    """True where a string column carries no usable value: null, blank, only punctuation, or a word for "unknown".

    The words are NO_VALUE_WORDS, alone or with the field's own last word before or after ("neighborhood unknown").
    """
    bare = F.lower(F.trim(F.regexp_replace(c, r"^[\s\p{Z}\p{P}\p{S}\p{C}]+|[\s\p{Z}\p{P}\p{S}\p{C}]+$", "")))
    bare = F.regexp_replace(bare, r"[\s_]+", " ")
    word = field.rsplit("_", 1)[-1].lower()
    forms = [*NO_VALUE_WORDS, *([f"{word} {w}" for w in NO_VALUE_WORDS if w] + [f"{w} {word}" for w in NO_VALUE_WORDS if w] if word else [])]
    return c.isNull() | bare.isin(*forms)


def usable_number(c: Column) -> Column:
    """A numeric column as double, with NaN and infinities turned to null."""
    d = c.cast("double")
    return F.when(d - d == 0, d)  # NaN for NaN and infinities


def seconds(c: Column | str) -> Column:
    """Seconds since 1970-01-01 of a timestamp with or without zone, read as UTC (fractions are cut off)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_seconds(c.cast("timestamp"))


def epoch_seconds(df: DataFrame, name: str) -> Column:
    """Like seconds(), but independent of the session's time zone for zone-free timestamps."""
    if dict(df.dtypes)[name] == "timestamp_ntz":
        return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{name}`)")
    return seconds(name)


def hash_unit(*cols: Column, seed: int = 0) -> Column:
    """A uniform number in (0, 1) that depends on the columns and the seed alone, not on the partitioning."""
    h = F.xxhash64(F.lit(seed), *cols)
    return (F.shiftrightunsigned(h, 12).cast("double") + 0.5) / float(1 << 52)


def quoted(names) -> list[Column]:
    """Columns by name, where names may hold dots."""
    return [F.col(f"`{n}`") for n in names]


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


Query = Callable[[SparkSession, str], DataFrame]

"""Column profiles per load: nulls, distinct values, ranges and written forms, and how they differ between loads.

The written form of a value is its mask: letters become A or a, digits 9, other characters stay, and runs of one class
longer than RUN are cut to RUN and a plus. Numbers are masked by sign, digits before and decimals after the point.
One pass over the table keeps, per task, a counter for each (load, column, mask, value); values of columns with more
than VALUES different values in a load are counted by mask alone. All columns, all rows and all loads take part.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.runtime import reliable_checkpoint

RUN = 12
#: A column is compared by values as well as by masks while a load has at most so many different ones.
VALUES = 64
NULL_MASK = "<null>"
TIME_MASKS = ("9999-99-99", "9999-99-99 99:99:99", "9999-99-99 99:99:99.9+")

_RUNS = re.compile(r"(.)\1{%d,}" % RUN, re.S)


_MIXED = re.compile(r"(?=[0-9]*[A-Za-z])(?=[A-Za-z]*[0-9])[A-Za-z0-9]{8,}")


def mask(text: str) -> str:
    """Character classes of a text, outer blanks included: `Bank card` is `Aaaa aaaa`, ` N` is ` A`.

    Eight or more letters and digits mixed are a code, masked by case and length: `X{32}`, `x{32}`.
    """
    text = _MIXED.sub(lambda m: ("\ue000" if m[0].islower() else "\ue001") + f"{len(m[0])}\ue002", text)
    if "\ue002" in text:
        return _MASKED.sub(lambda m: ("x" if m[1] == "\ue000" else "X") + "{" + m[2] + "}" if m[1] else _classes(m[3]), text)
    return _classes(text)


#: Private-use characters mark codes until the rest is masked.
_MASKED = re.compile("([\ue000\ue001])(\\d+)\ue002|([^\ue000\ue001]+)")


def _classes(text: str) -> str:
    out = "".join("9" if ch.isdigit() else ("A" if ch.isupper() or not ch.islower() else "a") if ch.isalpha() else ch for ch in text)
    return _RUNS.sub(lambda m: m[1] * RUN + "+", out)


def number_masks(v: np.ndarray) -> np.ndarray:
    """Mask codes of finite numbers: (negative, digits before the point, decimals up to 6) packed in an int."""
    a = np.abs(v)
    whole = np.floor(np.log10(np.maximum(a, 1))).astype(np.int64) + 1
    decimals = np.full(len(v), 6, np.int64)
    left = np.arange(len(v))
    for k in range(6):
        scaled = a[left] * 10.0**k
        done = np.abs(scaled - np.rint(scaled)) <= 1e-9 * np.maximum(scaled, 1)
        decimals[left[done]] = k
        left = left[~done]
        if not len(left):
            break
    return (v < 0) * 100_000 + np.minimum(whole, 999) * 10 + decimals


def number_mask_text(code: int) -> str:
    negative, whole, decimals = code >= 100_000, code % 100_000 // 10, code % 10
    return ("-" if negative else "") + "9" * min(whole, RUN) + ("+" if whole > RUN else "") + ("." + "9" * decimals if decimals else "")


def forms(df: DataFrame, load: str, columns: list[str] | None = None) -> DataFrame:
    """Counts per load, column, mask and value: load, column_name, mask, value, n.

    value is null where the column has more than VALUES different values in the load (the mask
    stands for them), and for null cells (mask <null>). Masks of timestamps are their ISO form's, with no time at midnight. Null loads are a load
    of their own. Any column type is taken; what is neither a number nor a text is cast to text.
    """
    columns = columns or [c for c in df.columns if c != load]
    kinds = dict(df.dtypes)
    picks = [F.col(load).cast("string").alias("__load")]
    numeric, times = [], []
    for i, c in enumerate(columns):
        if kinds[c] in ("timestamp", "timestamp_ntz"):
            times.append(i)
            picks.append((F.unix_micros(F.col(c).cast("timestamp"))).alias(f"c{i}"))
        elif re.match(r"tinyint|smallint|int|bigint|float|double", kinds[c]):
            numeric.append(i)
            picks.append(F.col(c).alias(f"c{i}"))
        else:
            picks.append(F.col(c).cast("string").alias(f"c{i}"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_value: dict[tuple, Counter] = {}
        by_mask: dict[tuple, Counter] = {}
        memo: dict[str, str] = {}

        def masked(text: str) -> str:
            m = memo.get(text)
            if m is None:
                if len(memo) > 200_000:
                    memo.clear()
                m = memo[text] = mask(text)
            return m

        for b in batches:
            loads = b.column(0)
            codes = loads.dictionary_encode() if not pa.types.is_dictionary(loads.type) else loads
            lcode = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            for l in np.unique(lcode):
                name = None if l < 0 else codes.dictionary[int(l)].as_py()
                rows = b if len(lcode) and (lcode == l).all() else b.filter(pa.array(lcode == l))
                for i in range(len(columns)):
                    arr = rows.column(i + 1)
                    key = (name, i)
                    seen_m = by_mask.setdefault(key, Counter())
                    seen_v = by_value.setdefault(key, Counter())
                    if i in times:
                        nulls = arr.null_count
                        v = arr.drop_null().to_numpy(zero_copy_only=False)
                        fine = np.where(v % 1_000_000 != 0, 2, np.where(v % 86_400_000_000 != 0, 1, 0))
                        for f, n in zip(*np.unique(fine, return_counts=True)):
                            seen_m[TIME_MASKS[f]] += int(n)
                        texts = None if len(v) else ()
                    elif i in numeric:
                        nulls = arr.null_count
                        v = arr.drop_null().to_numpy(zero_copy_only=False).astype(float)
                        bad = ~np.isfinite(v)
                        if bad.any():
                            for t, n in Counter(str(x) for x in v[bad]).items():
                                seen_m[t] += n
                                if seen_v is not None:
                                    seen_v[(t, t)] += n
                            v = v[~bad]
                        u, n = np.unique(v, return_counts=True)
                        c = number_masks(u) if len(u) else np.empty(0, np.int64)
                        for code in np.unique(c):
                            seen_m[number_mask_text(int(code))] += int(n[c == code].sum())
                        texts = ((number_mask_text(int(k)), repr(int(x)) if x == int(x) else repr(float(x)), int(m)) for k, x, m in zip(c, u, n)) if len(u) <= VALUES else None
                    else:
                        nulls = arr.null_count
                        vc = pc.value_counts(arr.drop_null())
                        vs, ns = vc.field(0).to_pylist(), vc.field(1).to_pylist()
                        ms = [masked(x) for x in vs]
                        for m, n in zip(ms, ns):
                            seen_m[m] += n
                        texts = zip(ms, vs, ns) if len(vs) <= VALUES else None
                    if nulls:
                        seen_m[NULL_MASK] += nulls
                    if seen_v is not None and by_value.get(key) is not None:
                        if texts is None:
                            by_value[key] = Counter({("\0", "\0"): 1})
                        elif ("\0", "\0") not in seen_v:
                            for m, x, n in texts:
                                seen_v[(m, x)] += n
                            if len(seen_v) > VALUES:
                                by_value[key] = Counter({("\0", "\0"): 1})
        out = []
        for (name, i), ms in by_mask.items():
            vs = by_value[(name, i)]
            whole = ("\0", "\0") in vs
            if whole:
                out += [(name, columns[i], m, None, n) for m, n in ms.items()]
            else:
                out += [(name, columns[i], m, x, n) for (m, x), n in vs.items()]
                if ms[NULL_MASK]:
                    out.append((name, columns[i], NULL_MASK, None, ms[NULL_MASK]))
        cols = list(zip(*out)) or [[]] * 5
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["load", "column_name", "mask", "value", "n"])

    parts = df.select(*picks).mapInArrow(count, "load string, column_name string, mask string, value string, n bigint")
    keys = ["load", "column_name", "mask", "value"]
    summed = parts.groupBy(*keys).agg(F.sum("n").alias("n"))
    # a task's share with too many values means as much for the load: the decision is that of the load's own count
    w = Window.partitionBy("load", "column_name")
    pooled = F.max(F.col("value").isNull() & (F.col("mask") != NULL_MASK)).over(w) | (F.count("value").over(w) > VALUES)
    return summed.withColumn("pooled", pooled).withColumn("value", F.when(~F.col("pooled"), F.col("value"))).groupBy(*keys).agg(F.sum("n").alias("n"))


def mask_profile(counts: DataFrame, rare: float = 0.001) -> DataFrame:
    """Masks per column over all loads: column_name, mask, n, share, dominant (the most frequent mask), rare_violation."""
    m = counts.groupBy("column_name", "mask").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("column_name")
    share = F.col("n") / F.sum("n").over(w)
    top = F.row_number().over(w.orderBy(F.desc("n"), "mask")) == 1
    return m.withColumn("share", share).withColumn("dominant", top).withColumn("rare_violation", (F.col("mask") != NULL_MASK) & (F.col("share") < rare))


def divergence(counts: DataFrame) -> DataFrame:
    """How far each load's distribution of forms is from that of most loads: load, column_name, n, forms, divergence, noise.

    A form is a mask with its value, or the mask alone where values are many. The reference of a form is the median
    of its share over all loads (0 where a load lacks it), scaled to 1: loads that depart don't pull it while fewer than half do.
    divergence is the Jensen-Shannon divergence in bits (0 to 1); noise is what sampling alone gives on average, about
    (forms - 1) / (8 n ln 2) for each side. Rows: loads times columns.
    """
    counts = reliable_checkpoint(counts)  # small, used several times below, and a pass over the table to make
    # a column whose values are too many in most loads is compared by masks throughout; else the loads where they are depart by their pooled values
    many = counts.groupBy("column_name", "load").agg(F.max(F.col("value").isNull() & (F.col("mask") != NULL_MASK)).alias("pooled"))
    many = many.groupBy("column_name").agg((F.avg(F.col("pooled").cast("int")) > 0.5).alias("many"))
    c = counts.join(many, "column_name").withColumn("form", F.when(F.col("many"), F.col("mask")).otherwise(F.concat_ws("\u0001", "mask", F.coalesce("value", F.lit("")))))
    c = c.groupBy("load", "column_name", "form").agg(F.sum("n").alias("n"))
    share = c.withColumn("total", F.sum("n").over(Window.partitionBy("load", "column_name"))).withColumn("share", F.col("n") / F.col("total"))
    loads = counts.groupBy("column_name").agg(F.count_distinct(F.struct("load")).alias("loads"))
    # the median over all loads, absent forms as zeros, from the shares that exist
    lists = share.groupBy("column_name", "form").agg(F.sort_array(F.collect_list("share")).alias("shares")).join(loads, "column_name")
    lacking = F.col("loads") - F.size("shares")
    middle = F.floor((F.col("loads") - 1) / 2), F.floor(F.col("loads") / 2)
    at = [F.when(k < lacking, F.lit(0.0)).otherwise(F.get("shares", (k - lacking).cast("int"))) for k in middle]
    ref = lists.select("column_name", "form", ((at[0] + at[1]) / 2).alias("ref"))
    # a column whose every form is absent from half of the loads (dates, say) has no reference, and its divergence is null
    ref = ref.withColumn("ref", F.try_divide(F.col("ref"), F.sum("ref").over(Window.partitionBy("column_name")))).where("ref is not null")
    spread = ref.where("ref > 0").groupBy("column_name").agg(F.count(F.lit(1)).alias("ref_forms"))

    def part(p: Column, q: Column) -> Column:  # p log2(p / m)
        return F.when(p > 0, p * F.log2(F.try_divide(p, (p + q) / 2))).otherwise(0.0)

    j = share.join(ref, ["column_name", "form"], "left").withColumn("known", F.col("ref").isNotNull()).withColumn("ref", F.coalesce("ref", F.lit(0.0)))
    sums = j.groupBy("load", "column_name").agg(
        F.max("total").alias("n"), F.count(F.lit(1)).alias("forms"), F.sum(part(F.col("share"), F.col("ref"))).alias("a"), F.sum(part(F.col("ref"), F.col("share"))).alias("b"), F.sum("ref").alias("met"), F.max("known").alias("known"),
    )
    # forms of the reference that the load lacks contribute ref * log2(2) each
    d = (F.col("a") + F.col("b") + F.greatest(F.lit(0.0), 1 - F.col("met"))) / 2
    s = sums.join(spread, "column_name", "left")
    forms_n = F.greatest("forms", F.coalesce("ref_forms", F.lit(0)))
    return s.select("load", "column_name", "n", "forms", F.when(F.col("known"), d).alias("divergence"), ((forms_n - 1) / (8 * F.col("n") * F.log(F.lit(2.0)))).alias("noise"))


def changed_loads(counts: DataFrame, least: float = 0.02) -> DataFrame:
    """Loads whose column departs clearly from most loads: load, column_name, mask_divergence, divergence.

    A load departs if its masks do, or its forms with their values: a divergence above `least` plus six times the sampling noise of either.
    """
    counts = reliable_checkpoint(counts)
    masks = counts.groupBy("load", "column_name", "mask").agg(F.sum("n").alias("n")).withColumn("value", F.lit(None).cast("string"))
    m = divergence(masks).select(F.col("load").alias("__l"), F.col("column_name").alias("__c"), F.col("divergence").alias("mask_divergence"), F.col("noise").alias("__noise"))
    d = divergence(counts)
    both = d.join(m, d["load"].eqNullSafe(m["__l"]) & (d["column_name"] == m["__c"]))
    odd = (F.col("mask_divergence") > least + 6 * F.col("__noise")) | (F.col("divergence") > least + 6 * F.col("noise"))
    return both.where(odd).select("load", "column_name", "mask_divergence", "divergence")


def ranges(df: DataFrame, load: str, columns: list[str] | None = None) -> DataFrame:
    """Per load and column: n, nulls (NaN counts as null), distinct_estimate (HyperLogLog, 5 % error), low and high as text.

    All columns in one aggregation, and the wide result (one row per load) is turned to long afterwards.
    """
    columns = columns or [c for c in df.columns if c != load]
    kinds = dict(df.dtypes)
    aggs = []
    for i, c in enumerate(columns):
        v = F.col(c)
        v = F.when(~F.isnan(v), v) if kinds[c] in ("double", "float") else v
        aggs += [F.count(v).alias(f"n{i}"), F.approx_count_distinct(v).alias(f"d{i}"), F.min(v).cast("string").alias(f"lo{i}"), F.max(v).cast("string").alias(f"hi{i}")]
    wide = df.groupBy(F.col(load).alias("load")).agg(F.count(F.lit(1)).alias("n"), *aggs)
    each = F.array(*[F.struct(F.lit(c).alias("column_name"), (F.col("n") - F.col(f"n{i}")).alias("nulls"), F.col(f"d{i}").alias("distinct_estimate"), F.col(f"lo{i}").alias("low"), F.col(f"hi{i}").alias("high")) for i, c in enumerate(columns)])
    return wide.select("load", "n", F.inline(each))

"""Distinct counts by linear counting: hashed bits in fixed bitmaps, merged by union, read off the share of empty bits.

A value sets one bit of m. With z empty bits, the estimate is -m * ln(z / m); its standard error, as a share of the
count n, is sqrt(m * (exp(t) - t - 1)) / n with t = n / m. size_bits() picks the smallest power of two that keeps this
under a target for the largest expected set. A bitmap is rows of 512 bits (eight 64-bit words), so a huge set is never
one row, pages that no value touches don't exist, and a small set takes no more rows than it has values. Words are united
by bitwise or in hash aggregation with map-side combination.

Every row carries the size of its bitmap. Partial results of loads or days are unions away from any coarser total; those of
different sizes are first folded to the smallest among them (the bit is the hash modulo a power of two). The bit
comes from MD5, so that it can be recomputed elsewhere.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a row, and its words.
PAGE = 512
WORDS = [f"w{i}" for i in range(PAGE // 64)]
#: Smallest bitmap.
LEAST_BITS = 32_768
#: The error bound is so many standard errors, and so many identifiers besides, as small sets are counted in whole ones.
DEVIATIONS, WHOLE = 4, 2


def standard_error(n: float, bits: int) -> float:
    """Relative standard error of linear counting for n values in so many bits."""
    if n <= 0:
        return 0.0
    t = n / bits
    return math.sqrt(bits * (math.exp(min(t, 700)) - t - 1)) / n


def size_bits(largest: float, target: float) -> int:
    """Smallest power of two, at least LEAST_BITS, whose standard error for `largest` values is within target."""
    bits = LEAST_BITS
    while standard_error(largest, bits) > target or largest > bits * math.log(bits) / 2:
        bits *= 2
    return bits


def bit_of(value: Column, bits: int) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(value.cast("binary")), 1, 12), 16, 10).cast("bigint"), F.lit(bits))


def _united(words: list[Column]) -> list[Column]:
    return [F.coalesce(F.bit_or(c), F.lit(0).cast("bigint")).alias(w) for w, c in zip(WORDS, words)]


def bitmaps(df: DataFrame, keys: list[str], value: Column, bits: int) -> DataFrame:
    """Partial results: keys, bits (size of the bitmap), page, w0 .. w7. Null values set no bit; null keys are a group of their own.

    Pages are united on the map side first, so a hot group ships at most bits / 512 rows per task.
    """
    if bits < PAGE or bits & (bits - 1):
        raise ValueError(f"a bitmap has a power of two of bits, at least {PAGE}, not {bits}")
    b = df.select(*keys, bit_of(value, bits).alias("__bit")).where("__bit is not null")
    page = F.expr(f"cast(__bit div {PAGE} as int)")
    mask, word = F.expr("shiftleft(1L, cast(__bit % 64 as int))"), F.expr(f"cast(__bit % {PAGE} div 64 as int)")
    cut = b.select(*keys, page.alias("page"), word.alias("__word"), mask.alias("__mask"))
    pages = cut.groupBy(*keys, "page").agg(*_united([F.when(F.col("__word") == i, F.col("__mask")) for i in range(len(WORDS))]))
    return pages.select(*keys, F.lit(bits).alias("bits"), "page", *WORDS)


def union(partial: DataFrame, keys: list[str]) -> DataFrame:
    """Merge partial bitmaps to coarser (or the same) keys by bitwise or; sizes that differ within a group are folded to its smallest."""
    once = partial.groupBy(*keys, "bits", "page").agg(*_united([F.col(w) for w in WORDS]))
    fold = once.withColumn("__bits", F.min("bits").over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))))
    fold = fold.withColumn("page", F.expr(f"cast(page % (__bits div {PAGE}) as int)")).drop("bits").withColumnRenamed("__bits", "bits")
    return fold.groupBy(*keys, "bits", "page").agg(*_united([F.col(w) for w in WORDS])).select(*keys, "bits", "page", *WORDS)


def estimates(maps: DataFrame, keys: list[str]) -> DataFrame:
    """keys, bits_set, estimate (rounded to a whole number) and error_bound, as a share of it, of united bitmaps.

    The bound is DEVIATIONS standard errors and WHOLE identifiers. A group whose bitmap is full can't be told from a larger one: its
    estimate is that of one empty bit, its error null.
    """
    held = sum((F.bit_count(w) for w in WORDS[1:]), F.bit_count(WORDS[0]))
    r = maps.groupBy(*keys).agg(F.sum(held).alias("bits_set"), F.max("bits").cast("double").alias("__m"))
    m = F.col("__m")
    raw = -m * F.log(F.greatest(m - F.col("bits_set"), F.lit(1.0)) / m)
    t = raw / m
    error = (DEVIATIONS * F.sqrt(F.greatest(m * (F.exp(t) - t - 1), F.lit(0.0))) + WHOLE) / raw
    return r.select(*keys, "bits_set", F.round(raw).cast("bigint").alias("estimate"), F.when(F.col("bits_set") < m, F.round(error, 6)).alias("error_bound"))

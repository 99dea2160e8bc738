"""Implausible readings per source: extreme-value cutoffs on seasonal residuals, stuck runs, plausibility rules.

Expectation. A reading is compared, in logarithms, with what each of the row's other fields implies for it: a direct
equivalent (say, time stamps for a duration), or the median reading among rows with a similar value of the other field
in the same season (hour class). Its residual is the smallest of these differences: a reading is only odd if nothing
else in the row bears it out. What a source always does - its median difference - is taken off per source.

Tails. Peaks over a threshold: excesses of the absolute, source-scaled residual over its 99 % quantile follow a generalised
Pareto law, but for the faults among them, which are a second, normal component of the likelihood. Shape and scale are those of
the highest posterior, with a published prior of the shape (Martins and Stedinger 2000: Beta(9, 6) on -0.5 .. 0.5). Sources have
tails of their own by partial pooling: a source's share of peaks and its scale are those of all sources, which count as PRIOR_PEAKS
peaks, together with its own; few sources have enough peaks for a shape of their own. A source's cutoff is the level that a sound
reading of it passes with probability RISK; nothing else bounds it.

Stuck runs. Rows are ordered per source within time chunks; runs at chunk borders are joined afterwards from one first
and one last run per chunk, so a source that holds a large share of all rows is never in one task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.runtime import reliable_checkpoint

#: Probability of a sound reading passing its cutoff.
RISK = 1e-5
#: Share of readings over the threshold, and peaks that all sources together count as in the tail of one.
PEAKS, PRIOR_PEAKS = 0.01, 20
#: A source's spread is set against that of all sources, which counts as this much at least (5 %), and by a factor of 2 at most.
LEAST_SPREAD = 0.05
STUCK = 8
#: Sources whose habits are broadcast at most (about 10 MB); beyond, the join is salted.
BROADCAST_SOURCES, SALTS = 100_000, 16
CHUNK = 86_400


@dataclass
class Reading:
    """A field to check: column; direct equivalents (columns in the same unit); other columns that move with it.

    grain: the size below which differences mean nothing; it is added before logarithms are taken.
    """

    column: str
    direct: list[str] = field(default_factory=list)
    related: list[str] = field(default_factory=list)
    grain: float = 0.0


def _log(c: str, grain: float = 0.0) -> Column:
    return F.when(F.col(c) + grain > 0 if not grain else F.col(c) >= 0, F.log(F.col(c) + grain))


#: Bins per unit of the logarithm: of the other field, of the reading (2.5 % wide), of residuals per source (2 % wide).
OTHER_BINS, VALUE_BINS, RESIDUAL_BINS = 4, 40, 50


def _logs(df: DataFrame, readings: list[Reading], grain: dict[str, float], direct: bool = False) -> DataFrame:
    """Add __l_<column>, the logarithm with its grain, of every column that takes part: each is computed once per row."""
    need = {c: grain.get(c, 0.0) for r in readings for c in (r.column, *r.related)}
    logs = {f"__l_{c}": _log(c, g) for c, g in need.items()}
    if direct:
        logs |= {f"__d_{r.column}_{d}": _log(d, r.grain) for r in readings for d in r.direct}
    return df.withColumns(logs)


def medians(df: DataFrame, readings: list[Reading], season: str) -> dict[str, dict[tuple[int, int], float]]:
    """Median log reading per pair of fields, season and bin of the other field, from one counting pass.

    The pass counts rows by (pair, season, bin, value bin), which is combined on the map side; what reaches the driver is
    one row per pair, season and bin of 20 rows or more: at most a few hundred log bins times the seasons.
    """
    pairs = [(f"e_{r.column}_{o}", r.column, o) for r in readings for o in r.related]
    if not pairs:
        return {}
    grain = {r.column: r.grain for r in readings}
    df = _logs(df, readings, grain)
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.floor(F.col(f"__l_{o}") * OTHER_BINS).cast("int").alias("b"), F.floor(F.col(f"__l_{c}") * VALUE_BINS).cast("int").alias("v")) for i, (_, c, o) in enumerate(pairs)])
    h = df.select(F.col(season).alias("s"), F.inline(each)).where("b is not null and v is not null").groupBy("i", "s", "b", "v").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("i", "s", "b")
    h = h.withColumn("n", F.sum("k").over(w)).withColumn("below", F.sum("k").over(w.orderBy("v")))
    rows = h.where("n >= 20 and below * 2 >= n and (below - k) * 2 < n").select("i", "s", "b", "v").collect()
    known: dict[str, dict[tuple[int, int], float]] = {}
    for x in rows:
        known.setdefault(pairs[x.i][0], {})[(x.s, x.b)] = (x.v + 0.5) / VALUE_BINS
    return known


def residuals(df: DataFrame, readings: list[Reading], known: dict[str, dict[tuple[int, int], float]], season: str) -> DataFrame:
    """Add r_<column>: log reading minus the nearest of its expectations; null if there is none."""
    diffs: dict[str, Column] = {}
    groups: dict[str, list[str]] = {}
    grain = {r.column: r.grain for r in readings}
    for r in readings:
        groups[r.column] = []
        for d in r.direct:
            diffs[f"d_{r.column}_{d}"] = F.col(f"__l_{r.column}") - F.col(f"__d_{r.column}_{d}")
            groups[r.column].append(f"d_{r.column}_{d}")
        for o in r.related:
            name = f"e_{r.column}_{o}"
            got = known.get(name)
            if not got:
                continue
            # an array literal indexed by season and bin: constant time per row, inside the generated code
            low, high = min(b for _, b in got), max(b for _, b in got)
            width, seasons = high - low + 1, max(s for s, _ in got) + 1
            cells = [got.get((s, b)) for s in range(seasons) for b in range(low, high + 1)]
            flat = F.expr("array(" + ", ".join("CAST(NULL AS DOUBLE)" if v is None else f"{v!r}D" for v in cells) + ")")
            bin_ = F.floor(F.col(f"__l_{o}") * OTHER_BINS).cast("int")
            at = F.when(bin_.between(low, high), F.col(season) * width + bin_ - low)  # out of the array's bounds: null
            diffs[name] = F.col(f"__l_{r.column}") - F.get(flat, at)
            groups[r.column].append(name)
    logged = _logs(df, readings, grain, direct=True)
    out = logged.withColumns(diffs)
    # Projections of their own: the optimizer keeps them apart, so each difference is computed once. Plain doubles, for the
    # generated method has to stay small enough for the JVM to compile it.
    out = out.withColumns({f"__a_{c}": F.least(*[F.abs(F.col(n)) for n in g]) for c, g in groups.items() if len(g) > 1})
    nearest = {}
    for c, g in groups.items():
        pick = F.col(g[-1]) if g else F.lit(None).cast("double")
        for n in g[-2::-1]:
            pick = F.when(F.abs(F.col(n)) <= F.col(f"__a_{c}"), F.col(n)).otherwise(pick)
        nearest[f"r_{c}"] = pick
    out = out.withColumns(nearest).drop(*[f"__a_{c}" for c in groups])
    return out.drop(*diffs, *[c for c in logged.columns if c not in df.columns])


@dataclass
class Tail:
    """Tail of the sound readings over a threshold: share of readings in it, shape and scale. sound: per bin from the threshold
    on, the probability that a reading there is sound."""

    threshold: float
    share: float
    shape: float
    scale: float
    sound: np.ndarray

    def cutoff(self, risk: float = RISK) -> float:
        if self.share <= risk:
            return self.threshold
        return self.threshold + self.scale * math.expm1(-self.shape * math.log(risk / self.share)) / self.shape


def fit_tail(bins: np.ndarray, counts: np.ndarray, width: float, peaks: float = PEAKS, rounds: int = 100) -> Tail:
    """Tail of counted readings by bin (ascending): expectation-maximisation over sound readings and faults, on a grid of shapes and scales.

    The threshold is the upper end of the last bin that more than a share `peaks` of readings reach. Shapes are in steps of 0.02, half
    a step off 0, scales in steps of 8 %. PRIOR_PEAKS exponential peaks, of the scale for which the threshold is passed by that share, are added
    to those seen, so that a few faults in a small table aren't taken for its tail.
    """
    n = counts.sum()
    over = np.flatnonzero(counts[::-1].cumsum()[::-1] <= peaks * n)
    if not len(over):
        return Tail(float((bins[-1] + 1) * width) if len(bins) else 0.0, 0.0, 0.01, width, np.zeros(0))
    b, c = bins[over], counts[over].astype(float)
    first = int(bins[over[0] - 1]) + 1 if over[0] else int(b[0])
    low = (b - first) * width
    usual = max(width, first * width / -math.log(peaks))
    high, mid = low + width, low + width / 2
    shapes = (np.arange(-24, 24) * 0.02 + 0.01)[:, None, None]
    scales = (width / 8 * 1.08 ** np.arange(120))[None, :, None]
    beyond = lambda x: np.maximum(0.0, 1 + shapes * x / scales) ** (-1 / shapes)
    fits = np.log(beyond(low) - beyond(high) + 1e-300)
    prior = (8 * np.log(0.5 + shapes) + 5 * np.log(0.5 - shapes) - PRIOR_PEAKS * (np.log(scales) + usual / scales))[:, :, 0]
    normal = lambda z: 0.5 * (1 + np.array([math.erf(v / math.sqrt(2)) for v in z]))
    # far above the usual peak: the first guess of what is no sound reading
    all_mid, all_c = np.append(mid, usual), np.append(c, PRIOR_PEAKS)
    order = np.argsort(all_mid)
    fault = (mid > 10 * all_mid[order][np.searchsorted(all_c[order].cumsum(), all_c.sum() / 2)]).astype(float)
    for _ in range(rounds):
        i, j = np.unravel_index((((1 - fault) * c * fits).sum(axis=2) + prior).argmax(), fits.shape[:2])
        part = (fault * c).sum() / c.sum()
        if part == 0:
            break
        mean = (fault * c * mid).sum() / (fault * c).sum()
        spread = max(math.sqrt((fault * c * (mid - mean) ** 2).sum() / (fault * c).sum()), 0.3)
        p, q = (1 - part) * np.exp(fits[i, j]), part * (normal((high - mean) / spread) - normal((low - mean) / spread))
        new = q / (p + q + 1e-300)
        done = np.abs(new - fault).max() < 1e-4
        fault = new
        if done:
            break
    sound = np.zeros(int(b[-1]) - first + 1)
    sound[(b - first).astype(int)] = 1 - fault
    return Tail(float(first * width), float((((1 - fault) * c).sum() + 1) / n), float(shapes[i, 0, 0]), float(scales[0, j, 0]), sound)


@dataclass
class SpikeModel:
    """What fit() learns: expectations, tails of all sources by reading, and habits (a row per source and reading: rows, peaks, centre, scale,
    tail_share, tail_scale, cutoff)."""

    readings: list[Reading]
    source: str
    season: str
    known: dict[str, dict[tuple[int, int], float]]
    habits: DataFrame
    tails: dict[str, Tail]
    risk: float = RISK

    def apply(self, df: DataFrame) -> DataFrame:
        """df with, per reading, r_<column> (scaled residual) and spike_<column> (boolean, false if unknowable)."""
        out = residuals(df, self.readings, self.known, self.season)
        cols = [r.column for r in self.readings]
        own = lambda i: F.max(F.when(F.col("field") == i, F.struct("centre", "scale", "cutoff")))
        habits = self.habits.groupBy("__source").agg(*[own(i).alias(f"__h_{c}") for i, c in enumerate(cols)])
        if habits.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
            j = out.join(F.broadcast(habits), out[self.source] == F.col("__source"), "left")
        else:  # a source may hold a third of all rows: its rows are joined in SALTS parts
            wide = habits.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            salted = out.withColumn("__salt", F.pmod(F.xxhash64(*out.columns), F.lit(SALTS)).cast("int"))
            j = salted.join(wide, (F.col(self.source) == F.col("__source")) & (F.col("__salt") == F.col("__part")), "left").drop("__salt", "__part")
        r = {f"r_{c}": (F.col(f"r_{c}") - F.coalesce(F.col(f"__h_{c}.centre"), F.lit(0.0))) / F.coalesce(F.col(f"__h_{c}.scale"), F.lit(1.0)) for c in cols}
        j = j.withColumns(r)
        # a source without peaks of its own in the data has no more than the tail of all
        odd = {f"spike_{c}": F.coalesce(F.abs(f"r_{c}") > F.coalesce(F.col(f"__h_{c}.cutoff"), F.lit(self.tails[c].cutoff(self.risk))), F.lit(False)) for c in cols}
        return j.withColumns(odd).drop("__source", *[f"__h_{c}" for c in cols])


def fit(df: DataFrame, readings: list[Reading], source: str, season: str, risk: float = RISK) -> SpikeModel:
    """Learn the expectations, each source's centre, spread and tail, in two counting passes.

    The second pass counts residuals by source and 2 % bin; quartiles per source, the tail of all sources and the peaks of each come
    from these counts. A source's centre is its median, shrunk to 0 for sources with few rows; its scale is its spread against that
    of all sources, between 1 and 2. Rows without source count for the tail of all, with centre 0.
    """
    known = medians(df, readings, season)
    r = residuals(df, readings, known, season)
    each = F.array(*[F.struct(F.lit(i).alias("field"), F.round(F.col(f"r_{x.column}") * RESIDUAL_BINS).cast("int").alias("b")) for i, x in enumerate(readings)])
    h = r.select(F.col(source).alias("__source"), F.inline(each)).where("b is not null").groupBy("__source", "field", "b").agg(F.count(F.lit(1)).alias("k"))
    h = reliable_checkpoint(h)
    w = Window.partitionBy("__source", "field")
    q = h.withColumn("n", F.sum("k").over(w)).withColumn("below", F.sum("k").over(w.orderBy("b")))
    reach = lambda p: F.min(F.when(F.col("below") >= F.col("n") * p, F.col("b"))) / RESIDUAL_BINS
    q = q.groupBy("__source", "field").agg(F.first("n").alias("n"), reach(0.25).alias("q1"), reach(0.5).alias("q2"), reach(0.75).alias("q3"))
    overall = {x.field: x for x in h.groupBy("field").agg(F.expr("percentile(b, array(0.25, 0.75), k)").alias("q")).collect()}
    spread = F.lit(1.0)
    for f, x in overall.items():
        spread = F.when(F.col("field") == f, max((x.q[1] - x.q[0]) / RESIDUAL_BINS / 1.349, LEAST_SPREAD)).otherwise(spread)
    # a source's habit counts once it has shown it in eight rows or more
    centre = F.when(F.col("n") >= 8, F.col("q2") * F.col("n") / (F.col("n") + 8)).otherwise(0.0)
    scale = F.least(F.lit(2.0), F.greatest(F.lit(1.0), F.when(F.col("n") >= 30, (F.col("q3") - F.col("q1")) / 1.349 / spread).otherwise(1.0)))
    q = reliable_checkpoint(q.select(F.col("__source").alias("__s"), F.col("field").alias("__f"), "n", F.when(F.col("__source").isNotNull(), centre).otherwise(0.0).alias("centre"), F.when(F.col("__source").isNotNull(), scale).otherwise(1.0).alias("scale")))
    scaled = h.join(q, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("field") == F.col("__f")))
    scaled = scaled.withColumn("a", F.floor(F.abs(F.col("b") / RESIDUAL_BINS - F.col("centre")) / F.col("scale") * RESIDUAL_BINS + 0.5).cast("int"))
    counted: dict[int, list[tuple[int, int]]] = {}
    for x in scaled.groupBy("field", "a").agg(F.sum("k").alias("k")).collect():  # a row per field and bin: logarithms of doubles have 75,000 bins at most
        counted.setdefault(x.field, []).append((x.a, x.k))
    tails = {}
    for i, x in enumerate(readings):
        rows = np.array(sorted(counted.get(i, [])), dtype=np.int64).reshape(-1, 2)
        tails[x.column] = fit_tail(rows[:, 0], rows[:, 1], 1 / RESIDUAL_BINS)
    by = lambda value: F.expr("array(" + ", ".join(f"{value(tails[x.column])!r}D" for x in readings) + ")")[F.col("__f")]
    first = F.round(by(lambda t: t.threshold) * RESIDUAL_BINS).cast("int")
    sound = F.expr("array(" + ", ".join("array(" + ", ".join(f"{v:.4f}D" for v in [*tails[x.column].sound, 0.0]) + ")" for x in readings) + ")")[F.col("__f")]
    weight = F.col("k") * F.get(sound, F.col("a") - first)
    peaks = scaled.where((F.col("a") >= first) & F.col("__s").isNotNull()).groupBy("__s", "__f").agg(F.sum(weight).alias("peaks"), F.sum(weight * (F.col("a") + 0.5 - first) / RESIDUAL_BINS).alias("excess"))
    own = q.where("__s is not null").join(peaks.withColumnsRenamed({"__s": "__ps", "__f": "__pf"}), (F.col("__s") == F.col("__ps")) & (F.col("__f") == F.col("__pf")), "left")
    own = own.fillna(0.0, ["peaks", "excess"])
    share, shape = by(lambda t: t.share), by(lambda t: t.shape)
    tail_share = (PRIOR_PEAKS + F.col("peaks")) / (PRIOR_PEAKS / F.greatest(share, F.lit(1e-12)) + F.col("n"))
    tail_scale = (PRIOR_PEAKS * by(lambda t: t.scale) + F.col("excess") * (1 - shape)) / (PRIOR_PEAKS + F.col("peaks"))
    own = own.select(F.col("__s").alias("__source"), F.col("__f").alias("field"), F.col("n").alias("rows"), "peaks", "centre", "scale", by(lambda t: t.threshold).alias("threshold"), shape.alias("shape"), tail_share.alias("tail_share"), tail_scale.alias("tail_scale"))
    level = F.col("threshold") + F.when(F.col("tail_share") > risk, F.col("tail_scale") * F.expm1(-F.col("shape") * F.log(risk / F.col("tail_share"))) / F.col("shape")).otherwise(0.0)
    return SpikeModel(readings, source, season, known, reliable_checkpoint(own.withColumn("cutoff", level)), tails, risk)


def stuck(df: DataFrame, columns: list[str], source: str, time_s: str, tie: list[str], exempt: dict[str, Column] | None = None, least: int = STUCK, chunk: int = CHUNK) -> DataFrame:
    """Add stuck_<column>: the row is in a run of at least `least` consecutive events of its source with one value.

    Rows with equal source and time_s are one event (records sent again); a missing value neither ends a run nor
    belongs to it; a row whose exempt condition holds counts like any other, but a run of which half or more is exempt isn't
    stuck. Rows without source or time are in no run. tie orders rows of one event.
    """
    exempt = exempt or {}
    inner = df.where(F.col(source).isNotNull() & F.col(time_s).isNotNull()).withColumn("__chunk", F.floor(F.col(time_s) / chunk))
    w = Window.partitionBy(source, "__chunk").orderBy(time_s, *tie)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    out = inner.withColumn("__event", F.coalesce((F.col(time_s) != F.lag(time_s).over(w)).cast("int"), F.lit(1)))
    for i, c in enumerate(columns):
        prev = F.last(c, True).over(before)
        out = out.withColumn(f"__new{i}", F.when(F.col(c).isNotNull(), (prev.isNull() | (prev != F.col(c))).cast("int")).otherwise(0))
    for i, c in enumerate(columns):
        out = out.withColumn(f"__run{i}", F.sum(f"__new{i}").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.drop(*[f"__new{i}" for i in range(len(columns))])
    # Aggregates, windows and the join below are all clustered by source and chunk: the rows are shuffled once for each use.
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"__run{i}").alias("run"), F.col(c).cast("double").alias("v"), exempt.get(c, F.lit(False)).cast("int").alias("free")) for i, c in enumerate(columns)])
    runs = out.select(source, "__chunk", "__event", F.inline(each)).where("v is not null").groupBy(source, "__chunk", "i", "run")
    runs = runs.agg(F.first("v").alias("v"), F.sum("__event").alias("events"), F.count(F.lit(1)).alias("rows"), F.sum("free").alias("free"))
    # Runs that touch neither border of their chunk can't be joined with others; only the long ones of them go on.
    edge = Window.partitionBy(source, "__chunk", "i")
    runs = runs.withColumn("lo", F.min("run").over(edge)).withColumn("hi", F.max("run").over(edge))
    runs = runs.where((F.col("run") == F.col("lo")) | (F.col("run") == F.col("hi")) | (F.col("events") >= least)).drop("lo", "hi")
    o = Window.partitionBy(source, "i").orderBy("__chunk", "run")
    joins = (F.lag("__chunk").over(o) != F.col("__chunk")) & (F.lag("v").over(o) == F.col("v"))
    runs = runs.withColumn("island", F.sum(F.when(joins, 0).otherwise(1)).over(o.rowsBetween(Window.unboundedPreceding, 0)))
    p = Window.partitionBy(source, "i", "island")
    runs = runs.withColumn("total", F.sum("events").over(p)).withColumn("all_rows", F.sum("rows").over(p)).withColumn("all_free", F.sum("free").over(p))
    bad = runs.where((F.col("total") >= least) & (F.col("all_free") * 2 < F.col("all_rows")))
    bad = bad.groupBy(source, "__chunk").agg(F.collect_list(F.struct("i", "run")).alias("__bad"))
    out = out.join(bad, [source, "__chunk"], "left")
    for i, c in enumerate(columns):
        hit = F.array_contains("__bad", F.struct(F.lit(i).alias("i"), F.col(f"__run{i}").alias("run")))
        out = out.withColumn(f"stuck_{c}", F.coalesce(hit, F.lit(False)) & F.col(c).isNotNull())
    out = out.drop("__chunk", "__event", "__bad", *[f"__run{i}" for i in range(len(columns))])
    rest = df.where(F.col(source).isNull() | F.col(time_s).isNull())
    for c in columns:
        rest = rest.withColumn(f"stuck_{c}", F.lit(False))
    return out.unionByName(rest)

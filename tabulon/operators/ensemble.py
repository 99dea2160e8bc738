"""Distributed learning and scoring with an ensemble of cross-categorization samples.

Samples start from independent chains, one task each, on at most `learn_rows` rows chosen by hash. All rows are then put to
groups in block Gibbs passes. For these, rows with equal values are counted once (the one shuffle of rows) and kept in packs, which depend
on the values alone; in each pass they are scored against the broadcast model once, how many of them go to each group is drawn at once
(as if each drew its own), and the statistics of all groups are summed in one aggregation, whose size is that of the model. Kinds and
hyperparameters are redrawn from the sums of all rows after each pass. Rows that draw a new group are seated among
themselves before the next pass, and passes go on while a sample's groups grow by more than chance (the root of their number). A pass reads the packs
twice, and only the rows that draw a new group are shuffled.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.functions import crosscat as cc
from tabulon.functions import schedules
from tabulon.functions.models import MODELS, stick_ends
from tabulon.functions.special import deal, hash_units
from tabulon.plans.encode import random_split
from tabulon.plans.schema import Feature
from tabulon.runtime import parallelism, quoted, union_all

#: Rows that chains see; they are broadcast, so this bounds the driver's and the workers' memory.
LEARN_ROWS = 20_000
#: Passes beyond the first of tables of up to 4,000 rows. The published schedule has 500 for a sampler that moves one row at a time.
FULL_PASSES = 10.0
#: A model of more numbers than this isn't broadcast but refused.
MODEL_LIMIT = 50_000_000
#: A pack holds at most so many combinations of values, and fewer of wide tables: so many cells.
PACK_ROWS, PACK_CELLS = 8192, 400_000
#: Cells that predict() puts out for one batch, if that is more than Spark's batches give.
BATCH_CELLS = 500_000
#: Cross-validation learns so many tables side by side.
SEEDS_AT_ONCE = 4


def extra_passes(rows: int) -> float:
    """Passes beyond the first that the schedule has for so many rows."""
    return schedules.extra_passes(rows, FULL_PASSES)


def columns_of(pdf: pd.DataFrame, models: dict[str, str]) -> dict[str, cc.Column]:
    """Values and observation masks of the encoded features in a batch."""
    out = {}
    for f, m in models.items():
        if f not in pdf:
            continue
        seen = pdf[f].notna().to_numpy()
        if m == "nich":
            v = pdf[f].to_numpy(float, na_value=np.nan)
            seen &= np.isfinite(v)
            v = np.where(seen, v, 0.0)
        elif m == "bb":
            v = np.where(seen, pdf[f].to_numpy(), False).astype(bool)
        else:
            v = np.where(seen, pdf[f].to_numpy(), 0).astype(np.int64)
        out[f] = (v, seen)
    return out


def narrow(df: DataFrame, models: dict[str, str], keep: tuple[str, ...] = ()) -> DataFrame:
    """row_id, the columns of keep as k0, k1, ... and the features as f0, f1, ...: names with dots don't pass through mapInPandas."""
    return df.select("row_id", *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], *[F.col(f"`{f}`").alias(f"f{i}") for i, f in enumerate(models)])


def named(batches: Iterator[pd.DataFrame], models: dict[str, str], keep: tuple[str, ...] = ()) -> Iterator[pd.DataFrame]:
    """Batches of narrow() with the features' names."""
    for b in batches:
        b.columns = ["row_id", *[f"k{i}" for i in range(len(keep))], *models]
        yield b


def larger(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """The batches put together to so many rows or a bit more, so that more equal ones meet; larger ones stay."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= rows:
            yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
            held, n = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def kept(b: pd.DataFrame, keep: tuple[str, ...]) -> pd.DataFrame:
    return b.iloc[:, : 1 + len(keep)].copy()


def kept_schema(df: DataFrame, keep: tuple[str, ...]) -> str:
    kinds = dict(df.dtypes)
    return "".join(f"k{i} {kinds[c]}, " for i, c in enumerate(keep))


def renamed(keep: tuple[str, ...]) -> dict[str, str]:
    return {f"k{i}": c for i, c in enumerate(keep)}


def model_size(samples: list[cc.Sample]) -> int:
    return sum(v.size for s in samples for k in s.kinds for st in k.stats.values() for v in st.values())


def share(spark: SparkSession, samples: list[cc.Sample]):
    """Broadcast the samples, if they are within MODEL_LIMIT numbers."""
    n = model_size(samples)
    if n > MODEL_LIMIT:
        raise ValueError(f"the model has {n} numbers, more than {MODEL_LIMIT}; use fewer samples, groups or symbols")
    return spark.sparkContext.broadcast([s.state() for s in samples])


def received(sent) -> list[cc.Sample]:
    """The broadcast samples, on a worker."""
    return [cc.Sample.from_state(s) for s in sent.value]


Sums = dict[tuple[int, int, str, str], np.ndarray]


@dataclass
class Packs:
    """A table's combinations of values, and how many rows have each. table: bucket, pack (see unpacked()); rows: of the table; whole: features without gaps."""

    table: DataFrame
    schema: str
    rows: int
    whole: set[str]


@contextmanager
def packed(df: DataFrame, models: dict[str, str]) -> Iterator[Packs]:
    """The rows of a table as Packs, which are kept meanwhile. What is in a pack, and its order, depend on the values alone."""
    finite = lambda f: F.when(~F.isnan(f"`{f}`") & (F.abs(f"`{f}`") < math.inf), F.col(f"`{f}`")) if models[f] == "nich" else F.col(f"`{f}`")
    names = [f"f{i}" for i in range(len(models))]
    slim = df.select(*[finite(f).alias(n) for f, n in zip(models, names)])
    each = slim.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).persist()
    packs = None
    try:
        r = each.agg(F.count(F.lit(1)), F.sum("n"), *[F.sum(F.when(F.col(n).isNotNull(), F.col("n"))) for n in names]).first()
        most = max(1, min(PACK_ROWS, PACK_CELLS // len(models)))
        buckets = max(1, -(-r[0] // max(1, min(most, max(512, r[0] // 32)))))
        hashed = each.withColumn("h", F.xxhash64(*names)).withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))

        def pack(b: pd.DataFrame) -> pd.DataFrame:
            b = b.sort_values(["h", *names], kind="stable")
            columns = columns_of(b[names].set_axis(list(models), axis=1), models)
            cells = {f: (*np.unique(v, return_inverse=True), seen) for f, (v, seen) in columns.items()}
            return pd.DataFrame({"bucket": b.bucket.iloc[:1], "pack": [pickle.dumps((b.n.to_numpy(np.int64), {f: (u, i.astype(np.int32), seen) for f, (u, i, seen) in cells.items()}))]})

        parts = max(min(buckets, 4 * parallelism(df.sparkSession)), buckets // 64)
        packs = hashed.groupBy("bucket").applyInPandas(pack, "bucket int, pack binary").repartition(parts).persist()
        packs.count()
        each.unpersist()
        yield Packs(packs, ", ".join(f"{n} {t}" for n, t in slim.dtypes), r[1] or 0, {f for i, f in enumerate(models) if r[i + 2] == r[1]})
    finally:
        each.unpersist()
        if packs is not None:
            packs.unpersist()


def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, np.ndarray, dict[str, tuple], dict[str, cc.Column], cc.Codes]]:
    """Of each pack: its number, how many rows each combination has, its cells (values, place among them, observed), its columns, and the columns' codes."""
    for b in batches:
        for bucket, data in zip(b.bucket, b.pack):
            counts, cells = pickle.loads(data)
            columns = {f: (u[i], seen) for f, (u, i, seen) in cells.items()}
            yield int(bucket), counts, cells, columns, cc.Codes(columns, len(counts))


def _generator(*seed: int) -> np.random.Generator:
    return np.random.default_rng([x & 0xFFFFFFFF for x in seed])


def _add_statistics(sums: Sums, sample: cc.Sample, l: int, k: int, dealt: tuple[np.ndarray, np.ndarray, np.ndarray], cells: dict[str, tuple]) -> None:
    """Add what deal_groups() dealt to the additive statistics by (sample, kind, feature, statistic); the arrays' first axis is the group."""

    def add(key: tuple[int, int, str, str], part: np.ndarray) -> None:
        if key in sums:
            sums[key] += part
        else:
            sums[key] = part.astype(float)

    kind, (at, g, w) = sample.kinds[k], dealt
    groups = len(kind.counts)
    add((l, k, "", "rows"), np.bincount(g, w, groups))
    for f in kind.features:
        u, place, seen = cells[f]
        name, h = sample.models[f], sample.hypers[f]
        own = slice(None) if seen.all() else seen[at]
        x, a, n = place[at[own]], g[own], w[own]
        if groups * len(u) <= 4 * len(x):  # a value's rows in a group count as one
            both = np.bincount(a * len(u) + x, n, groups * len(u))
            x = np.flatnonzero(both)
            a, x, n = x // len(u), x % len(u), both[x]
        x = u[x]
        if name == "nich":
            d = x - h["mu"]
            st = {"n": np.bincount(a, n, groups), "s1": np.bincount(a, d * n, groups), "s2": np.bincount(a, d * d * n, groups)}
        else:
            st = MODELS[name].from_rows(h, x, a, groups, n)
        for s, part in st.items():
            add((l, k, f, s), part)


def _rows_of(sums: Sums) -> pd.DataFrame | None:
    """The statistics that aren't 0, as rows."""
    out = []
    for (l, k, f, s), a in sums.items():
        at = np.nonzero(a)
        if len(at[0]):
            out.append(pd.DataFrame({"sample": np.int32(l), "kind": np.int32(k), "feature": f, "grp": at[0].astype(np.int32), "stat": s, "code": at[1].astype(np.int32) if len(at) > 1 else np.int32(0), "value": a[at]}))
    return pd.concat(out) if out else None


def _rebuild(samples: list[cc.Sample], rows: list, renumber: bool = True) -> list[cc.Sample]:
    """Samples with the statistics that were summed; renumber drops groups that became empty but one."""
    new = []
    for s in samples:
        kinds = [cc.Kind(k.features, k.alpha, k.d, np.zeros(len(k.counts)), {f: MODELS[s.models[f]].empty(s.hypers[f], len(k.counts)) for f in k.features}) for k in s.kinds]
        new.append(cc.Sample(s.models, s.hypers, kinds, s.topology))
    sums: dict[tuple, dict[str, np.ndarray]] = {}
    for r in rows:
        kind = new[r.sample].kinds[r.kind]
        if r.stat == "rows":
            kind.counts[r.grp] += r.value
        elif new[r.sample].models[r.feature] == "nich":
            sums.setdefault((r.sample, r.kind, r.feature), {}).setdefault(r.stat, np.zeros(len(kind.counts)))[r.grp] += r.value
        else:
            a = kind.stats[r.feature][r.stat]
            a[(r.grp, r.code) if a.ndim > 1 else r.grp] += r.value
    for (l, k, f), st in sums.items():
        h, n = new[l].hypers[f], st["n"]
        s1, s2 = st.get("s1", np.zeros_like(n)), st.get("s2", np.zeros_like(n))
        safe = np.maximum(n, 1)
        new[l].kinds[k].stats[f] = {"n": n, "mean": np.where(n > 0, h["mu"] + s1 / safe, 0.0), "m2": np.maximum(s2 - s1 * s1 / safe, 0.0)}
    for s in new:
        s.rows = int(s.kinds[0].counts.sum()) if s.kinds else 0
    return [s.with_empty() for s in new] if renumber else new


def assign(df: DataFrame, samples: list[cc.Sample], seed: int = 0) -> DataFrame:
    """row_id, sample, kind, grp: each row's group, drawn from its posterior with a number of its own."""
    every = [(l, k) for l, s in enumerate(samples) for k in range(len(s.kinds))]
    rows = assign_arrays(df, samples, every, seed)
    named = [F.struct(F.lit(l).alias("sample"), F.lit(k).alias("kind"), F.element_at("groups", i + 1).alias("grp")) for i, (l, k) in enumerate(every)]
    return rows.select("row_id", F.inline(F.array(*named)))


def assign_arrays(df: DataFrame, samples: list[cc.Sample], wanted: list[tuple[int, int]], seed: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """row_id, the columns of keep, and groups: the row's groups in the wanted (sample, kind)s, in one row. Only these kinds are scored."""
    sent = share(df.sparkSession, samples)
    models = samples[0].models

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = received(sent)
        for b in named(batches, models, keep):
            ids, cols = b.row_id.to_numpy(), columns_of(b, models)
            codes = cc.Codes(cols, len(b))
            g = [own[l].draw_groups(k, cols, len(b), hash_units(ids, seed, l, k), codes) for l, k in wanted]
            yield kept(b, keep).assign(groups=list(np.stack(g, axis=1).astype(np.int32)))

    return narrow(df, models, keep).mapInPandas(run, f"row_id bigint, {kept_schema(df, keep)}groups array<int>").withColumnsRenamed(renamed(keep))


def gibbs_pass(df: DataFrame, samples: list[cc.Sample], seed: int = 0, renumber: bool = True) -> list[cc.Sample]:
    """One block Gibbs pass over all rows: the samples with statistics of the new groups of all rows.

    Without renumber, groups keep their numbers, so that the statistics can be added to those of other rows.
    """
    with packed(df, samples[0].models) as packs:
        return _rebuild(samples, _pass_sums(packs, samples, seed, None), renumber)


def _across(sample: cc.Sample, groups: int) -> cc.Sample:
    """The sample's kinds, and one more of so many groups, each with all features and no statistics."""
    every = sorted(sample.models)
    kinds = [cc.Kind(every, k.alpha, k.d, np.zeros(len(k.counts)), {}) for k in sample.kinds]
    return cc.Sample(sample.models, sample.hypers, [*kinds, cc.Kind(every, 2.0, 0.1, np.zeros(groups), {})], sample.topology)


def _pass_sums(packs: Packs, samples: list[cc.Sample], seed: int, ends: list[np.ndarray] | None) -> list:
    """Summed statistics of a block Gibbs pass. With ends, those of every feature in every kind, and in a kind whose groups are these shares of all rows."""
    sent = share(packs.table.sparkSession, samples)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, sums = received(sent), {}
        wide = own if ends is None else [_across(s, len(e)) for s, e in zip(own, ends)]
        with np.errstate(divide="ignore"):
            shares = [np.log(np.diff(e, prepend=0.0))[None, :] for e in ends or []]
        for bucket, counts, cells, columns, codes in unpacked(batches):
            for l, s in enumerate(own):
                for k in range(len(s.kinds)):
                    _add_statistics(sums, wide[l], l, k, s.deal_groups(k, columns, counts, _generator(seed, l, k, bucket), codes), cells)
                if ends is not None:
                    _add_statistics(sums, wide[l], l, len(s.kinds), deal(_generator(seed, l, len(s.kinds), bucket), shares[l], np.zeros(len(counts), np.int64), counts), cells)
        found = _rows_of(sums)
        if found is not None:
            yield found

    parts = packs.table.mapInPandas(run, "sample int, kind int, feature string, grp int, stat string, code int, value double")
    summed = parts.groupBy("sample", "kind", "feature", "grp", "stat", "code").agg(F.sum("value").alias("value"))
    return summed.collect()


def structured_pass(packs: Packs, samples: list[cc.Sample], seed: int, config: cc.Config) -> list[cc.Sample]:
    """A block Gibbs pass, then kinds and hyperparameters redrawn from the statistics of all rows."""
    rng = np.random.default_rng(seed)
    ends = [stick_ends(rng, 2.0, 0.1) for _ in samples]
    size = sum(sum(len(k.counts) for k in s.kinds) * sum(v[:1].size for k in s.kinds for st in k.stats.values() for v in st.values()) for s in samples)
    if size > MODEL_LIMIT:
        raise ValueError(f"kinds are compared by {size} numbers, more than {MODEL_LIMIT}; use fewer samples, groups or symbols")
    sums = _pass_sums(packs, samples, seed, ends)
    # the auxiliary kinds' groups that have rows, numbered anew
    last = [len(s.kinds) for s in samples]
    seated = [{g: i for i, g in enumerate(sorted({r.grp for r in sums if r.sample == l and r.kind == last[l]}))} for l in range(len(samples))]
    sums = [r if r.kind < last[r.sample] else Row(**{**r.asDict(), "grp": seated[r.sample][r.grp]}) for r in sums]
    out = []
    for s in _rebuild([_across(s, max(1, len(g))) for s, g in zip(samples, seated)], sums, renumber=False):
        old = samples[len(out)]
        names = sorted(s.models)
        where = np.array([old.kind_of(f) for f in names])
        if config.infer_kinds and len(names) > 1:
            like = np.array([[MODELS[s.models[f]].marginal(s.hypers[f], k.stats[f]).sum() for k in s.kinds] for f in names])
            where = cc.move_features(rng, where, like, s.topology, config.kind_iterations)
        kinds = []
        for i, k in enumerate(s.kinds):
            own = [f for j, f in enumerate(names) if where[j] == i]
            if own:
                kinds.append(cc.Kind(own, k.alpha, k.d, k.counts, {f: k.stats[f] for f in own}))
        new = cc.Sample(s.models, dict(s.hypers), kinds, s.topology, s.rows)
        if config.infer_hypers:
            cc.redraw_hypers(new, rng, packs.whole)
        out.append(new.with_empty())
    return out


def open_groups(df: DataFrame, samples: list[cc.Sample], seed: int = 0, passes: float = 0.0, most: int = LEARN_ROWS) -> list[cc.Sample]:
    """The samples with groups for the rows that draw a new one: these are seated one after another among themselves, in 1 + passes passes.

    At most `most` rows of each kind of a sample, chosen by hash, are seated in one call.
    """
    with packed(df, samples[0].models) as packs:
        return _open_groups(packs, samples, seed, passes, most)


def _open_groups(packs: Packs, samples: list[cc.Sample], seed: int, passes: float, most: int = LEARN_ROWS) -> list[cc.Sample]:
    sent = share(packs.table.sparkSession, samples)
    models = samples[0].models

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = received(sent)
        for bucket, counts, _, columns, codes in unpacked(batches):
            for l, s in enumerate(own):
                for k, kind in enumerate(s.kinds):
                    rng = _generator(seed, l, k, bucket)
                    scores, code = s.coded_scores(k, columns, len(counts), codes)
                    p = np.exp(scores - scores.max(axis=1, keepdims=True))
                    fresh = np.minimum(p[:, kind.counts == 0].sum(axis=1) / p.sum(axis=1), 1.0)
                    at = np.repeat(np.arange(len(counts)), rng.binomial(counts, fresh[code]))
                    if len(at):
                        rows = {f"f{i}": pd.arrays.IntegerArray(columns[f][0][at], ~columns[f][1][at]) if m in ("gp", "dd", "dpd") else pd.arrays.BooleanArray(columns[f][0][at], ~columns[f][1][at]) if m == "bb" else np.where(columns[f][1][at], columns[f][0][at], np.nan) for i, (f, m) in enumerate(models.items())}
                        turn = rng.random(len(at))
                        yield pd.DataFrame({**rows, "row_id": bucket, "sample": np.int32(l), "kind": np.int32(k), "turn": turn})

    def seat(b: pd.DataFrame) -> pd.DataFrame:
        l, k = int(b["sample"].iloc[0]), int(b["kind"].iloc[0])
        s = received(sent)[l]
        kind, b = s.kinds[k], b.sort_values(["turn", "row_id"], kind="stable")
        own = {f: models[f] for f in kind.features}
        cols = columns_of(b[["row_id", *[f"f{i}" for i in range(len(models))]]].set_axis(["row_id", *models], axis=1), own)
        c = cc.Chain(own, cols, len(b), seed, cc.Config(extra_passes=passes, infer_kinds=False, infer_hypers=False))
        c.sample = cc.Sample(own, {f: s.hypers[f] for f in own}, [cc.Kind(kind.features, kind.alpha, kind.d, np.zeros(1), {f: MODELS[own[f]].empty(s.hypers[f], 1) for f in own})])
        c.assign = [np.full(len(b), -1, np.int64)]
        found = c.run().sorted_groups()[0].kinds[0]
        return pd.DataFrame({"sample": [np.int32(l)], "kind": [np.int32(k)], "groups": [pickle.dumps((found.counts, found.stats))]})

    fresh = packs.table.mapInPandas(run, f"{packs.schema}, row_id bigint, sample int, kind int, turn double")
    fresh = fresh.withColumn("place", F.row_number().over(Window.partitionBy("sample", "kind").orderBy("turn", "row_id"))).where(F.col("place") <= most).drop("place")
    out = [s.with_empty() for s in samples]
    for r in fresh.groupBy("sample", "kind").applyInPandas(seat, "sample int, kind int, groups binary").collect():
        kind, (counts, stats) = out[r.sample].kinds[r.kind], pickle.loads(r.groups)
        kind.counts = np.concatenate([kind.counts, counts])
        kind.stats = {f: {n: np.concatenate([v, stats[f][n]]) for n, v in st.items()} for f, st in kind.stats.items()}
    return [s.with_empty() for s in out]


def settle(df: DataFrame, samples: list[cc.Sample], passes: int = 1, seed: int = 0, config: cc.Config | None = None) -> list[cc.Sample]:
    """Samples after `passes` passes over all rows, and more of them while a sample's groups grow by more than the root of their number.

    Passes open groups for rows of no group, put all rows to groups, and redraw kinds and hyperparameters from all rows. A single greedy pass
    (extra_passes 0) leaves kinds and hyperparameters.
    """
    config = config or cc.Config()
    out, active, turn = list(samples), list(range(len(samples))), 0
    with packed(df, samples[0].models) as packs:
        while active:
            own = _open_groups(packs, [out[l] for l in active], seed + 2 * turn + 1, config.extra_passes)
            own = _rebuild(own, _pass_sums(packs, own, seed + 2 * turn, None)) if config.extra_passes <= 0 else structured_pass(packs, own, seed + 2 * turn, config)
            turn += 1
            held = lambda s: sum(int((k.counts > 0).sum()) for k in s.kinds) / max(1, len(s.kinds))
            more = [held(s) > held(out[l]) + math.sqrt(held(out[l])) for l, s in zip(active, own)]
            for l, s in zip(active, own):
                out[l] = s
            active = [l for l, m in zip(active, more) if m or turn < passes]
    return out


def learn(df: DataFrame, features: list[Feature], samples: int = 2, config: cc.Config | None = None, learn_rows: int = LEARN_ROWS, passes: int | None = None, seed: int = 0) -> list[cc.Sample]:
    """Posterior samples of an encoded table: chains on at most learn_rows rows, then block Gibbs passes over all rows.

    Kinds and hyperparameters come from all rows (see settle). Without config, chains make as many passes as the schedule has
    for their rows; without passes, all rows get as many as it has for them, or 1 + config's extra passes. Chains are independent tasks. An empty table gives samples without rows. Rows with equal row_id count each.
    """
    spark = df.sparkSession
    models = {f.name: f.model for f in features}
    part = random_split(df.select("row_id", *quoted(models)), "row_id", learn_rows, seed).where("train").drop("train")
    pdf = part.toPandas().sort_values("row_id", kind="stable")
    data = spark.sparkContext.broadcast(pdf)
    codes = {f.name: f.codes for f in features}
    sampled = len(pdf) >= learn_rows
    if passes is None:
        passes = 1 + math.ceil(config.extra_passes if config else extra_passes(df.count())) if sampled else 1
    config = config or cc.Config(extra_passes=extra_passes(len(pdf)))

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in b.seed:
                cols = columns_of(data.value, models)
                c = cc.Chain(models, cols, len(data.value), int(s), config)
                widen(c.sample, codes)
                c.run()
                yield pd.DataFrame({"seed": [s], "sample": [pickle.dumps(c.sorted_groups()[0].state())], "log": [repr(c.log)]})

    seeds = spark.range(seed * 1000, seed * 1000 + samples, 1, samples).withColumnRenamed("id", "seed")
    # sorted here: for a sort by Spark, whose ranges are sampled first, chains would run twice
    found = sorted(seeds.mapInPandas(chain, "seed bigint, sample binary, log string").collect(), key=lambda r: r.seed)
    out = [cc.Sample.from_state(pickle.loads(r.sample)).with_empty() for r in found]
    if sampled or passes > 1:
        out = settle(df, out, passes, seed, config)
    return out


def mix(df: DataFrame, samples: list[cc.Sample], passes: int = 3, seed: int = 0) -> list[cc.Sample]:
    """Samples after so many more block Gibbs passes over all rows, or more while groups open (see settle)."""
    return settle(df, samples, passes, seed + 7919)


def widen(sample: cc.Sample, codes: dict[str, int]) -> None:
    """Give categorical features room for every code of their dictionary, seen by the chain or not."""
    for k in sample.kinds:
        for f in k.features:
            h, n = sample.hypers[f], codes.get(f, 0)
            if sample.models[f] == "dd" and n > len(h["alphas"]):
                h["alphas"] = np.append(h["alphas"], np.full(n - len(h["alphas"]), 0.5))
            elif sample.models[f] == "dpd" and n > len(h["betas"]):
                b = np.asarray(h["betas"], float)
                b = np.concatenate([b[:-1], np.full(n - len(b), b[-1] / (n - len(b) + 1)), b[-1:] / (n - len(b) + 1)])
                h["betas"] = b / b.sum()
            k.stats[f] = MODELS[sample.models[f]].empty(h, len(k.counts))


def single_pass(df: DataFrame, features: list[Feature], samples: int = 1, seed: int = 0, block: int = LEARN_ROWS) -> list[cc.Sample]:
    """Greedy inference: groups of a first block of rows, then passes over all rows until none of them opens a group; kinds and hyperparameters stay."""
    return learn(df, features, samples, cc.Config(extra_passes=0.0), block, 1, seed)


def score(df: DataFrame, samples: list[cc.Sample], keep: tuple[str, ...] = ()) -> DataFrame:
    """row_id, the columns of keep, and score: the log probability of each row's observed values, averaged over samples. A row of nulls has 0."""
    sent = share(df.sparkSession, samples)
    models = {f: m for f, m in samples[0].models.items() if f in df.columns}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = received(sent)
        for b in named(batches, models, keep):
            yield kept(b, keep).assign(score=cc.ensemble_score(own, columns_of(b, models), len(b)))

    return narrow(df, models, keep).mapInPandas(run, f"row_id bigint, {kept_schema(df, keep)}score double").withColumnsRenamed(renamed(keep))


def complete(df: DataFrame, samples: list[cc.Sample], wanted: list[str] | None = None, count: int = 10, seed: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """row_id, the columns of keep, draw and all features, `count` rows each: observed values are kept, unobserved wanted ones drawn."""
    sent = share(df.sparkSession, samples)
    models = {f: m for f, m in samples[0].models.items() if f in df.columns}
    wanted = [f for f in (wanted or list(models)) if f in models]
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = received(sent)
        for b in named(larger(batches, BATCH_CELLS // (max(1, len(models)) * count)), models, keep):
            cols = columns_of(b, models)
            at = np.flatnonzero(np.any([~cols[f][1] for f in wanted], axis=0)) if wanted else np.zeros(0, np.int64)
            drawn = cc.draw(own, {f: (v[at], seen[at]) for f, (v, seen) in cols.items()}, len(at), wanted, count, b.row_id.to_numpy()[at], seed, gaps=True)
            out = kept(b, keep).iloc[np.repeat(np.arange(len(b)), count)].reset_index(drop=True).assign(draw=np.tile(np.arange(count, dtype=np.int32), len(b)))
            for f, m in models.items():
                v, seen = cols[f]
                x, there = np.repeat(v.astype(float), count), np.repeat(seen, count)
                if f in drawn:
                    free = ~seen[at]
                    x.reshape(len(b), count)[at[free]] = drawn[f][free]
                    there = np.ones(len(x), bool)
                if m == "bb":
                    out[f] = pd.array(x > 0.5, dtype="boolean")
                    out.loc[~there, f] = pd.NA
                elif m == "nich":
                    out[f] = np.where(there, x, np.nan)
                else:
                    out[f] = pd.array(np.where(there, x, 0).astype(np.int64), dtype="Int64")
                    out.loc[~there, f] = pd.NA
            out.columns = ["row_id", *renamed(keep), "draw", *[f"f{i}" for i in range(len(models))]]
            yield out

    schema = f"row_id bigint, {kept_schema(df, keep)}draw int, " + ", ".join(f"f{i} {kinds[f]}" for i, f in enumerate(models))
    done = narrow(df, models, keep).mapInPandas(run, schema)
    return done.select("row_id", *[F.col(k).alias(c) for k, c in renamed(keep).items()], "draw", *[(F.when(~F.isnan(f"f{i}"), F.col(f"f{i}")) if m == "nich" else F.col(f"f{i}")).alias(f) for i, (f, m) in enumerate(models.items())])


def information(spark: SparkSession, samples: list[cc.Sample], pairs: list[tuple[frozenset[str], frozenset[str]]], condition: dict | None = None, count: int = 1000, seed: int = 0) -> DataFrame:
    """Mutual information of pairs of feature sets: i (place in pairs), mi, variance, relatedness. One task per block of pairs.

    Every task draws the same rows from the seed, so entropies of a set agree everywhere.
    """
    sent = share(spark, samples)
    condition = condition or {}
    every = sorted({f for a, b in pairs for f in a | b})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = received(sent)
        for b in batches:
            own = [pairs[i] for i in b.i]
            sets = list({s for x, y in own for s in (x, y, x | y)} | {frozenset(every)})
            e = cc.entropies(mine, sets, condition, count, seed)
            m = [cc.mutual_information(e, x, y) for x, y in own]
            yield pd.DataFrame({"i": b.i, "mi": [x.mean for x in m], "variance": [x.variance for x in m], "relatedness": [1.0 if p[0] == p[1] else cc.relatedness(x.mean) for p, x in zip(own, m)]})

    ids = spark.createDataFrame([(i,) for i in range(len(pairs))], "i int").repartition(min(max(1, len(pairs) // 16), spark.sparkContext.defaultParallelism * 4))
    return ids.mapInPandas(run, "i int, mi double, variance double, relatedness double")


def derivative(df: DataFrame, samples: list[cc.Sample], rows: list[dict], seed: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """How much each given row, once learnt, raises each table row's score: update (place in rows), row_id, the columns of keep, score.

    score = N * (score after - score before), N the number of rows learnt. The samples themselves stay as they are.
    """
    spark = df.sparkSession
    rng = np.random.default_rng(seed)
    after = [[cc.add_row(s, r, rng) for s in samples] for r in rows]
    if model_size(samples) * (len(rows) + 1) > MODEL_LIMIT:
        raise ValueError("too many rows for one call; pass them in blocks")
    sent = spark.sparkContext.broadcast(([s.state() for s in samples], [[s.state() for s in ss] for ss in after]))
    models = {f: m for f, m in samples[0].models.items() if f in df.columns}
    n = max(s.rows for s in samples)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        old, new = sent.value
        before, later = [cc.Sample.from_state(s) for s in old], [[cc.Sample.from_state(s) for s in ss] for ss in new]
        for b in named(batches, models, keep):
            cols = columns_of(b, models)
            base = cc.ensemble_score(before, cols, len(b))
            for u, ss in enumerate(later):
                yield kept(b, keep).assign(update=np.int32(u), score=n * (cc.ensemble_score(ss, cols, len(b)) - base))

    return narrow(df, models, keep).mapInPandas(run, f"row_id bigint, {kept_schema(df, keep)}update int, score double").withColumnsRenamed(renamed(keep))


def metrics(samples: list[cc.Sample]) -> list[dict]:
    """Per sample: rows, kinds, groups, log likelihood, and the KL estimate (-score - log n) / n."""
    out = []
    for l, s in enumerate(samples):
        t, n = s.log_likelihood(), max(s.rows, 1)
        out.append({"sample": l, "rows": s.rows, "kinds": len(s.kinds), "groups": sum(int((k.counts > 0).sum()) for k in s.kinds), "score": t, "kl_divergence": (-t - math.log(n)) / n})
    return out


def held_out(df: DataFrame, features: list[Feature], proportion: float = 0.9, seeds: int = 2, **options) -> DataFrame:
    """Cross-validation: for each seed, learn on an exact share of the rows and score the rest: seed, rows, mean_score.

    Seeds are independent; up to SEEDS_AT_ONCE of them learn side by side, so that the cores which one leaves idle are used.
    """
    n = df.count()

    def one(seed: int) -> DataFrame:
        split = random_split(df, "row_id", int(proportion * n), seed)
        ss = learn(split.where("train").drop("train"), features, seed=seed, **options)
        return score(split.where("not train").drop("train"), ss).agg(F.lit(seed).alias("seed"), F.count(F.lit(1)).alias("rows"), F.avg("score").alias("mean_score"))

    with ThreadPoolExecutor(SEEDS_AT_ONCE) as pool:
        return union_all(list(pool.map(one, range(seeds))))

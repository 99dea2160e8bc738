"""Cross-categorization: columns in kinds, rows clustered within each kind; one posterior sample as plain numpy.

A Sample holds, per kind, its features, the Pitman-Yor hyperparameters of its row partition, group sizes and statistics.
Chain learns a Sample by Gibbs sampling over rows (groups), features (kinds) and hyperparameters.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from tabulon.functions import grids
from tabulon.functions.models import MODELS, Hypers, Stats, partition_prior, partition_score, partition_scores, sample_partition
from tabulon.functions.schedules import actions
from tabulon.functions.special import choose, choose_coded, choose_rows, deal, hash_units, log_sum_exp

#: Values of one feature: the values and which are observed.
Column = tuple[np.ndarray, np.ndarray]


class Codes:
    """Which rows of a batch have equal values in a set of features; each set is worked out once."""

    def __init__(self, columns: dict[str, Column], n: int):
        self.columns, self.n, self.known = columns, n, {}

    def of(self, features: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The first row of each combination of values, and which combination each row has; all rows are their own where most differ."""
        key = tuple(sorted(features))
        if key not in self.known:
            self.known[key] = self._of(key)
        return self.known[key]

    def _of(self, key: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
        n, every = self.n, np.arange(self.n)
        if len(key) <= 1:
            if not key or not n:
                return every[:1], np.zeros(n, np.int64)
            v, seen = self.columns[key[0]]
            code = np.unique(v, return_inverse=True)[1] * 2 + seen
        else:
            (first, a), (other, b) = self.of(list(key[:-1])), self.of([key[-1]])
            if len(first) * 4 > n or len(other) * 4 > n:
                return every, every
            code = a * len(other) + b
        _, first, code = np.unique(code, return_index=True, return_inverse=True)
        return (every, every) if len(first) * 4 > n and n > 16 else (first, code)


@dataclass
class Kind:
    features: list[str]
    alpha: float
    d: float
    counts: np.ndarray
    stats: dict[str, Stats]


@dataclass
class Sample:
    """One posterior draw. models: feature to model name; hypers: feature to hyperparameters; topology: (alpha, d)."""

    models: dict[str, str]
    hypers: dict[str, Hypers]
    kinds: list[Kind]
    topology: tuple[float, float] = (2.0, 0.1)
    rows: int = 0

    def state(self) -> dict:
        """The sample as plain dictionaries and arrays, which any process can unpickle."""
        kinds = [(k.features, k.alpha, k.d, k.counts, k.stats) for k in self.kinds]
        return {"models": self.models, "hypers": self.hypers, "kinds": kinds, "topology": self.topology, "rows": self.rows}

    @classmethod
    def from_state(cls, s: dict) -> Sample:
        return cls(s["models"], s["hypers"], [Kind(*k) for k in s["kinds"]], s["topology"], s["rows"])

    def kind_of(self, feature: str) -> int:
        return next(k for k, kind in enumerate(self.kinds) if feature in kind.features)

    def validate(self) -> None:
        """Every feature is in exactly one kind, with statistics for every group."""
        seen = [f for k in self.kinds for f in k.features]
        if sorted(seen) != sorted(self.models) or any(len(v) != len(k.counts) for k in self.kinds for f in k.features for v in k.stats[f].values()):
            raise ValueError("every feature must be in exactly one kind, with statistics for every group")

    def with_empty(self) -> Sample:
        """The sample with exactly one empty group per kind, so that a new group's share of the prior is there."""
        kinds = []
        for k in self.kinds:
            keep = np.flatnonzero(k.counts > 0)
            stats = {f: MODELS[self.models[f]].extend(self.hypers[f], MODELS[self.models[f]].take(k.stats[f], keep), 1) for f in k.features}
            kinds.append(Kind(k.features, k.alpha, k.d, np.append(k.counts[keep], 0), stats))
        return Sample(self.models, self.hypers, kinds, self.topology, self.rows)

    def prior(self, k: int) -> np.ndarray:
        kind = self.kinds[k]
        return partition_prior(kind.counts, kind.alpha, kind.d)

    def group_scores(self, k: int, columns: dict[str, Column], n: int, only: set[str] | None = None) -> np.ndarray:
        """Rows x groups: log prior plus log probabilities of the observed values of the kind's features."""
        kind = self.kinds[k]
        s = np.tile(self.prior(k), (n, 1))
        for f in kind.features:
            if f not in columns or (only is not None and f not in only):
                continue
            values, seen = columns[f]
            at = np.flatnonzero(seen)
            if len(at):
                s[at] += MODELS[self.models[f]].table(self.hypers[f], kind.stats[f], values[at])
        return s

    def coded_scores(self, k: int, columns: dict[str, Column], n: int, codes: Codes | None = None) -> tuple[np.ndarray, np.ndarray]:
        """group_scores() of one row of each combination of the kind's values, and which one each row has."""
        own = [f for f in self.kinds[k].features if f in columns]
        first, code = (codes or Codes(columns, n)).of(own)
        return self.group_scores(k, {f: (columns[f][0][first], columns[f][1][first]) for f in own}, len(first)), code

    def draw_groups(self, k: int, columns: dict[str, Column], n: int, u: np.ndarray, codes: Codes | None = None) -> np.ndarray:
        """A group for each row, drawn by its scores with its own uniform number; rows with equal values are scored once."""
        return choose_coded(u, *self.coded_scores(k, columns, n, codes))

    def deal_groups(self, k: int, columns: dict[str, Column], counts: np.ndarray, rng: np.random.Generator, codes: Codes | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Groups of rows that stand for counts equal ones each, of which each draws its own: see deal()."""
        return deal(rng, *self.coded_scores(k, columns, len(counts), codes), counts)

    def score(self, columns: dict[str, Column], n: int, codes: Codes | None = None) -> np.ndarray:
        """Log probability of each row's observed values under this sample; kinds with nothing observed say nothing. Rows with equal values are scored once."""
        total, codes = np.zeros(n), codes or Codes(columns, n)
        for k, kind in enumerate(self.kinds):
            if any(f in columns and columns[f][1].any() for f in kind.features):
                scores, code = self.coded_scores(k, columns, n, codes)
                total += log_sum_exp(scores, axis=1)[code]
        return total

    def log_likelihood(self) -> float:
        """Log marginal likelihood of the data, partitions and topology that the statistics stand for."""
        t = partition_score(np.array([len(k.features) for k in self.kinds]), *self.topology)
        for k in self.kinds:
            t += partition_score(k.counts, k.alpha, k.d)
            t += sum(float(MODELS[self.models[f]].marginal(self.hypers[f], k.stats[f]).sum()) for f in k.features)
        return t


def initial_sample(models: dict[str, str], columns: dict[str, Column], rng: np.random.Generator) -> Sample:
    """Features shuffled into kinds of sizes 1, 2, 4, ...; hyperparameters from the data's scale; no rows."""
    names = sorted(models)
    rng.shuffle(names)
    hypers = {f: MODELS[m].default(columns[f][0][columns[f][1]]) for f, m in models.items()}
    kinds, size = [], 1
    while names:
        own, names = names[:size], names[size:]
        kinds.append(Kind(own, 2.0, 0.1, np.zeros(1), {f: MODELS[models[f]].empty(hypers[f], 1) for f in own}))
        size *= 2
    return Sample(models, hypers, kinds)


def move_features(rng: np.random.Generator, where: np.ndarray, like: np.ndarray, topology: tuple[float, float], iterations: int) -> np.ndarray:
    """Kinds of features after so many Gibbs sweeps. like: features x kinds, log marginal likelihoods; kinds without features share a new one's prior."""
    where, (alpha, d), kinds = where.tolist(), topology, like.shape[1]
    counts = np.bincount(where, minlength=kinds).tolist()
    best = (like - like.max(axis=1, keepdims=True)).tolist()
    prior = [math.log(max(c - d, 1e-300)) for c in range(len(where) + 1)]  # of a kind with c features
    for _ in range(iterations):  # plain numbers: there are few features and kinds, and many steps
        for j in rng.permutation(len(where)):
            counts[where[j]] -= 1
            used = sum(c > 0 for c in counts)
            fresh = math.log((alpha + d * used) / max(1, kinds - used))
            scores = [b + (prior[c] if c else fresh) for b, c in zip(best[j], counts)]
            top = max(scores)
            p = [math.exp(x - top) for x in scores]
            u, k = rng.random() * sum(p), 0
            while k < kinds - 1 and u >= p[k]:
                u -= p[k]
                k += 1
            where[j] = k
            counts[k] += 1
    return np.array(where)


def redraw_hypers(s: Sample, rng: np.random.Generator, whole: set[str]) -> None:
    """Hyperparameters drawn on their grids, from statistics. whole: features without gaps."""
    pairs = grids.pitman_yor()
    s.topology = pairs[choose(rng, partition_scores(np.array([len(k.features) for k in s.kinds]), pairs))]
    for kind in s.kinds:
        kind.alpha, kind.d = pairs[choose(rng, partition_scores(kind.counts, pairs))]
        for f in kind.features:
            m, h = MODELS[s.models[f]], s.hypers[f]
            if m.name == "dpd":
                if f in whole:
                    h = m.redraw_base(h, kind.stats[f], rng)
                order = ["alpha"]
            else:
                order = list(m.grid(h))
            for name in order:
                points = m.grid(h)[name]
                if m.name == "dd":
                    h = {"alphas": np.array(h["alphas"], float)}
                    for j in rng.permutation(len(h["alphas"])):
                        h["alphas"][j] = points[choose(rng, m.code_scores(h, j, points, kind.stats[f]))]
                else:
                    h = {**h, name: float(points[choose(rng, m.grid_scores(h, name, points, kind.stats[f]))])}
            s.hypers[f] = h


@dataclass
class Config:
    """Inference settings. extra_passes 0 is a single greedy pass; kind_iterations sweeps over features per kind step.

    grain: rows that a chain moves at once, as a share of those that are in; they don't see each other. Up to 1 / grain rows go one by one.
    """

    extra_passes: float = 1.5
    kind_iterations: int = 32
    empty_kinds: int = 1
    most_rejects: int = 100
    infer_kinds: bool = True
    infer_hypers: bool = True
    grain: float = 0.0625


class Chain:
    """Gibbs sampling over rows in memory, in seeded order. columns: feature to (values, observed), all of `rows` rows."""

    def __init__(self, models: dict[str, str], columns: dict[str, Column], rows: int, seed: int, config: Config | None = None):
        self.rng = np.random.default_rng(seed)
        self.config, self.columns, self.rows = config or Config(), columns, rows
        self.sample = initial_sample(models, columns, self.rng)
        self.assign = [np.full(rows, -1, np.int64) for _ in self.sample.kinds]
        self.order = self.rng.permutation(rows)
        self.log: list[dict] = []
        self.whole = {f for f, (_, seen) in columns.items() if seen.all()}
        self.rejects = 0

    # -- rows ----------------------------------------------------------------------------------------------------
    def row_scores(self, k: int, i: int) -> np.ndarray:
        kind = self.sample.kinds[k]
        s = partition_prior(kind.counts, kind.alpha, kind.d)
        for f in kind.features:
            v, seen = self.columns[f]
            if seen[i]:
                s = s + MODELS[self.sample.models[f]].predictive(self.sample.hypers[f], kind.stats[f], v[i])
        return s

    def put(self, k: int, i: int, g: int, sign: int) -> None:
        kind = self.sample.kinds[k]
        kind.counts[g] += sign
        for f in kind.features:
            v, seen = self.columns[f]
            if seen[i]:
                MODELS[self.sample.models[f]].add(self.sample.hypers[f], kind.stats[f], g, v[i], sign)

    def add(self, i: int) -> None:
        for k in range(len(self.sample.kinds)):
            self.room(k)
            g = choose(self.rng, self.row_scores(k, i))
            self.put(k, i, g, 1)
            self.assign[k][i] = g
        self.sample.rows += 1

    def remove(self, i: int) -> None:
        for k in range(len(self.sample.kinds)):
            self.put(k, i, self.assign[k][i], -1)
            self.assign[k][i] = -1
        self.sample.rows -= 1

    def values(self, k: int, at: np.ndarray) -> dict[str, Column]:
        return {f: (self.columns[f][0][at], self.columns[f][1][at]) for f in self.sample.kinds[k].features}

    def room(self, k: int) -> None:
        """At least one empty group."""
        kind = self.sample.kinds[k]
        if kind.counts.all():
            kind.counts = np.append(kind.counts, 0)
            for f in kind.features:
                kind.stats[f] = MODELS[self.sample.models[f]].extend(self.sample.hypers[f], kind.stats[f], 1)

    def move(self, k: int, at: np.ndarray, g: np.ndarray, sign: int) -> None:
        """Add rows to groups, or take them out."""
        kind, n = self.sample.kinds[k], len(self.sample.kinds[k].counts)
        kind.counts = kind.counts + sign * np.bincount(g, minlength=n)
        for f, (v, seen) in self.values(k, at).items():
            m = MODELS[self.sample.models[f]]
            part = m.from_rows(self.sample.hypers[f], v[seen], g[seen], n)
            kind.stats[f] = m.merge(kind.stats[f], part) if sign > 0 else m.less(kind.stats[f], part)

    def add_rows(self, at: np.ndarray) -> None:
        """Add rows that don't see each other; those that draw a new group are seated one by one in the groups that these open."""
        if len(at) == 1:
            return self.add(int(at[0]))
        for k in range(len(self.sample.kinds)):
            self.room(k)
            kind = self.sample.kinds[k]
            was_empty = kind.counts == 0
            g = choose_rows(self.rng.random(len(at)), self.sample.group_scores(k, self.values(k, at), len(at)))
            fresh = was_empty[g]
            self.move(k, at[~fresh], g[~fresh], 1)
            self.assign[k][at[~fresh]] = g[~fresh]
            old = np.flatnonzero(~was_empty)
            for i in at[fresh]:
                self.room(k)
                scores = self.row_scores(k, i)
                scores[old] = -np.inf
                self.assign[k][i] = choose(self.rng, scores)
                self.put(k, i, self.assign[k][i], 1)
        self.sample.rows += len(at)

    def remove_rows(self, at: np.ndarray) -> None:
        if len(at) == 1:
            return self.remove(int(at[0]))
        for k in range(len(self.sample.kinds)):
            self.move(k, at, self.assign[k][at], -1)
            self.assign[k][at] = -1
        self.sample.rows -= len(at)

    def recount(self) -> None:
        """Statistics anew from the rows, so that rounding doesn't add up; groups beyond one empty one are dropped."""
        for k, kind in enumerate(self.sample.kinds):
            keep = kind.counts > 0
            new = np.where(keep, np.cumsum(keep) - 1, -1)
            self.assign[k] = np.where(self.assign[k] >= 0, new[self.assign[k]], -1)
            n = int(keep.sum()) + 1
            kind.counts = np.append(kind.counts[keep], 0)
            kind.stats = {f: self.feature_stats(f, self.assign[k], n) for f in kind.features}

    # -- features ------------------------------------------------------------------------------------------------
    def feature_stats(self, f: str, assign: np.ndarray, groups: int) -> Stats:
        v, seen = self.columns[f]
        at = np.flatnonzero(seen & (assign >= 0))
        return MODELS[self.sample.models[f]].from_rows(self.sample.hypers[f], v[at], assign[at], groups)

    def kind_step(self) -> int:
        """Block Gibbs of features over kinds, with empty kinds drawn from the prior; returns how many features moved."""
        s, rng = self.sample, self.rng
        there = np.flatnonzero(self.assign[0] >= 0)
        for _ in range(self.config.empty_kinds):
            a = np.full(self.rows, -1, np.int64)
            a[there] = sample_partition(rng, len(there), 2.0, 0.1)
            n = int(a.max()) + 1 if len(there) else 1
            s.kinds.append(Kind([], 2.0, 0.1, np.bincount(a[there], minlength=max(n, 1)).astype(float), {}))
            self.assign.append(a)
        names = sorted(s.models)
        like, stats = np.zeros((len(names), len(s.kinds))), {}
        for k, kind in enumerate(s.kinds):
            for j, f in enumerate(names):
                st = self.feature_stats(f, self.assign[k], len(kind.counts))
                like[j, k] = MODELS[s.models[f]].marginal(s.hypers[f], st).sum()
                stats[j, k] = st
        where = np.array([s.kind_of(f) for f in names])
        start = where.copy()
        where = move_features(rng, where, like, s.topology, self.config.kind_iterations)
        for k, kind in enumerate(s.kinds):
            kind.features = [names[j] for j in np.flatnonzero(where == k)]
            kind.stats = {names[j]: stats[j, k] for j in np.flatnonzero(where == k)}
        keep = [k for k, kind in enumerate(s.kinds) if kind.features]
        s.kinds, self.assign = [s.kinds[k] for k in keep], [self.assign[k] for k in keep]
        return int((where != start).sum())

    # -- hyperparameters -----------------------------------------------------------------------------------------
    def hyper_step(self) -> None:
        redraw_hypers(self.sample, self.rng, self.whole)

    # -- runs ----------------------------------------------------------------------------------------------------
    def note(self, passes: float) -> None:
        s = self.sample
        self.log.append({"passes": passes, "rows": s.rows, "kinds": len(s.kinds), "groups": sum(int((k.counts > 0).sum()) for k in s.kinds), "score": s.log_likelihood()})

    def run(self) -> Chain:
        """The schedule: annealed adding and removing until every row is in; kinds and hyperparameters in between."""
        c = self.config
        if not self.rows:
            return self
        added = 0
        for what, first, last in actions(self.rows, max(0.0, c.extra_passes), c.grain):
            if what == "redraw":
                self.between()
                self.note(added / self.rows)
                continue
            at = self.order[np.arange(first, last) % self.rows]
            if what == "add":
                self.add_rows(at)
                added = last
            else:
                self.remove_rows(at)
        if c.extra_passes <= 0:
            self.note(1.0)
        return self

    def between(self) -> None:
        """Redraw kinds, unless they stayed the same too many times in a row, and hyperparameters."""
        self.recount()
        if self.config.infer_kinds and len(self.sample.models) > 1 and self.rejects <= self.config.most_rejects:
            self.rejects = 0 if self.kind_step() else self.rejects + 1
        if self.config.infer_hypers:
            self.hyper_step()

    def sweep(self) -> None:
        """One Gibbs pass over all rows, kinds and hyperparameters (all rows must be in)."""
        for i in self.rng.permutation(self.rows):
            self.remove(i)
            self.add(i)
        if self.config.infer_kinds and len(self.sample.models) > 1:
            self.kind_step()
        if self.config.infer_hypers:
            self.hyper_step()

    def sorted_groups(self) -> tuple[Sample, list[np.ndarray]]:
        """The sample with non-empty groups by falling size (ties by their old number), and assignments to match."""
        kinds, assigns = [], []
        for k, kind in enumerate(self.sample.kinds):
            order = np.lexsort((np.arange(len(kind.counts)), -kind.counts))
            order = order[kind.counts[order] > 0]
            new = np.full(len(kind.counts) + 1, -1, np.int64)
            new[order] = np.arange(len(order))
            kinds.append(Kind(sorted(kind.features), kind.alpha, kind.d, kind.counts[order], {f: MODELS[self.sample.models[f]].take(kind.stats[f], order) for f in kind.features}))
            assigns.append(new[self.assign[k]])
        s = self.sample
        return Sample(s.models, s.hypers, kinds, s.topology, s.rows), assigns


# -- queries over several samples --------------------------------------------------------------------------------------
def ensemble_score(samples: list[Sample], columns: dict[str, Column], n: int) -> np.ndarray:
    """Log probability of rows averaged over samples."""
    codes = Codes(columns, n)
    return log_sum_exp(np.stack([s.score(columns, n, codes) for s in samples]), axis=0) - math.log(len(samples))


def draw(samples: list[Sample], columns: dict[str, Column], n: int, wanted: list[str], count: int, ids: np.ndarray, seed: int = 0, gaps: bool = False) -> dict[str, np.ndarray]:
    """`count` draws of the wanted features for each row, given its observed values: feature to array (rows x count).

    Samples are weighted by how well they explain the row with all its kinds; within a draw, features of a kind share a
    group. Draws of a row are in order of their sample. Numbers come from hashes of (row id, draw), so results don't depend on
    batches or partitions. With gaps, observed values aren't drawn but stay 0.
    """
    codes = Codes(columns, n)
    per = [[s.coded_scores(k, columns, n, codes) for k in range(len(s.kinds))] for s in samples]
    weights = np.stack([sum((log_sum_exp(g, axis=1)[c] for g, c in gs), np.zeros(n)) for gs in per], axis=1)
    flat = (np.asarray(ids, np.int64)[:, None] * np.int64(1_000_003) + np.arange(count)).ravel()
    row = np.repeat(np.arange(n), count)
    which = np.sort(choose_rows(hash_units(flat, seed, 1), weights[row]).reshape(n, count), axis=1).ravel()
    out = {f: np.zeros(n * count) for f in wanted}
    for l, s in enumerate(samples):
        at = np.flatnonzero(which == l)
        if not len(at):
            continue
        for k, kind in enumerate(s.kinds):
            fs = [f for f in kind.features if f in out]
            free = {f: ~columns[f][1][row[at]] if gaps and f in columns else np.ones(len(at), bool) for f in fs}
            some = np.flatnonzero(np.any(list(free.values()), axis=0)) if fs else []
            if not len(some):
                continue
            scores, code = per[l][k]
            g = choose_coded(hash_units(flat[at[some]], seed, 2, k), scores, code[row[at[some]]])
            for f in fs:
                own = np.flatnonzero(free[f][some])
                if len(own):
                    j, to = wanted.index(f), at[some[own]]
                    out[f][to] = MODELS[s.models[f]].sample(s.hypers[f], kind.stats[f], g[own], lambda i, j=j, to=to: hash_units(flat[to], seed, 3, j, i))
    return {f: v.reshape(n, count) for f, v in out.items()}


@dataclass
class Estimate:
    mean: float
    variance: float


def entropies(samples: list[Sample], sets: list[frozenset[str]], condition: dict[str, object], count: int, seed: int) -> dict[frozenset[str], Estimate]:
    """Entropy of each feature set given the condition, by Monte Carlo over `count` shared draws (two at least)."""
    if count < 2:
        raise ValueError("entropy needs two samples or more")
    wanted = sorted(frozenset().union(*sets)) if sets else []
    base = {f: (np.array([v]), np.array([True])) for f, v in condition.items() if v is not None}
    drawn = draw(samples, base, 1, wanted, count, np.zeros(1, np.int64), seed)
    cond = {f: (np.repeat(v, count), np.repeat(o, count)) for f, (v, o) in base.items()}
    given = ensemble_score(samples, base, 1)[0]
    out = {}
    for fs in {*sets, frozenset()}:
        if not fs:
            out[fs] = Estimate(0.0, 0.0)
            continue
        cols = {**cond, **{f: (drawn[f][0], np.ones(count, bool)) for f in fs}}
        x = given - ensemble_score(samples, cols, count)
        out[fs] = Estimate(float(x.mean()), float(x.var(ddof=1) / count))
    return out


def mutual_information(e: dict[frozenset[str], Estimate], a: frozenset[str], b: frozenset[str]) -> Estimate:
    """H(A) + H(B) - H(A and B); of a set with itself, its entropy."""
    if a == b:
        return e[a]
    return Estimate(e[a].mean + e[b].mean - e[a | b].mean, e[a].variance + e[b].variance + e[a | b].variance)


def relatedness(information: float) -> float:
    """Mutual information in nats to 0..1: the correlation of two Gaussians with as much of it; below 1 always."""
    return min(math.sqrt(max(0.0, -math.expm1(-2 * max(information, 0.0)))), math.nextafter(1.0, 0.0))


def add_row(sample: Sample, row: dict[str, object], rng: np.random.Generator) -> Sample:
    """A copy of the sample with one more row, put to a group of each kind by its posterior."""
    s = sample.with_empty()
    columns = {f: (np.array([v]), np.array([True])) for f, v in row.items() if v is not None and f in s.models}
    kinds = []
    for k, kind in enumerate(s.kinds):
        g = choose(rng, s.group_scores(k, columns, 1)[0])
        counts = kind.counts.copy()
        counts[g] += 1
        stats = {f: {n: v.copy() for n, v in st.items()} for f, st in kind.stats.items()}
        for f in kind.features:
            if f in columns:
                MODELS[s.models[f]].add(s.hypers[f], stats[f], g, columns[f][0][0])
        kinds.append(Kind(kind.features, kind.alpha, kind.d, counts, stats))
    return Sample(s.models, s.hypers, kinds, s.topology, s.rows + 1).with_empty()


def posterior_draws(chain: Chain, count: int, skip: int = 10):
    """`count` draws from a chain whose rows are all in, `skip` sweeps apart: (sample, assignments per kind)."""
    for _ in range(count):
        for _ in range(skip):
            chain.sweep()
        yield chain.sorted_groups()


def kind_changes(before: Sample, after: Sample) -> dict[str, int]:
    """How the partition of features changed: kinds that weren't there before, that are there no more, and features in other company."""
    a, b = ({frozenset(k.features) for k in s.kinds} for s in (before, after))
    company = [{f: k for k in kinds for f in k} for kinds in (a, b)]
    moved = sum(company[0][f] != company[1][f] for f in company[0])
    return {"born": len([k for k in b if k not in a]), "gone": len([k for k in a if k not in b]), "changed": moved}

import math
from collections import Counter
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabulon.functions import crosscat as cc
from tabulon.functions import grids, schedules
from tabulon.functions.models import MODELS, partition_prior, partition_score, sample_partition
from tabulon.functions.special import choose_rows, hash_units, lgamma, log_sum_exp

DATA = {
    "bb": st.lists(st.booleans(), min_size=1, max_size=12), "dd": st.lists(st.integers(0, 4), min_size=1, max_size=12), "dpd": st.lists(st.integers(0, 4), min_size=1, max_size=12),
    "gp": st.lists(st.integers(0, 50), min_size=1, max_size=12), "nich": st.lists(st.floats(-50, 50), min_size=1, max_size=12),
}
HYPERS = {
    "bb": {"alpha": 0.5, "beta": 1.5}, "dd": {"alphas": np.array([0.5, 1, 2, 0.1, 0.3])}, "dpd": {"gamma": 1.0, "alpha": 1.3, "betas": np.array([0.3, 0.2, 0.2, 0.1, 0.1, 0.1])},
    "gp": {"alpha": 2.0, "inv_beta": 0.3}, "nich": {"mu": 1.0, "kappa": 0.5, "sigmasq": 2.0, "nu": 3.0},
}


@pytest.mark.parametrize("name", list(MODELS))
def test_predictives_add_up_to_the_marginal_and_removal_undoes_addition(name):
    m, h = MODELS[name], HYPERS[name]

    @settings(max_examples=30, deadline=None)
    @given(DATA[name])
    def check(values):
        s, total = m.empty(h, 2), 0.0
        for x in values:
            total += m.predictive(h, s, x)[1]
            m.add(h, s, 1, x)
        v = np.array(values)
        rows = m.from_rows(h, v, np.ones(len(v), int), 2)
        assert total == pytest.approx(m.marginal(h, s)[1], abs=1e-6)
        assert m.marginal(h, rows)[1] == pytest.approx(total, abs=1e-6)
        half = len(v) // 2
        both = m.merge(m.from_rows(h, v[:half], np.ones(half, int), 2), m.from_rows(h, v[half:], np.ones(len(v) - half, int), 2))
        assert m.marginal(h, both)[1] == pytest.approx(total, abs=1e-6)
        assert m.table(h, s, v)[0] == pytest.approx(m.predictive(h, s, values[0]), abs=1e-9)
        for x in values:
            m.add(h, s, 1, x, -1)
        assert all(np.abs(a).max() < 1e-6 for a in s.values())

    check()


@pytest.mark.parametrize("name", ["bb", "dd", "dpd"])
def test_discrete_predictives_are_normalised(name):
    m, h = MODELS[name], HYPERS[name]
    s = m.from_rows(h, np.array([1, 0, 1]), np.zeros(3, int), 1)
    values = [False, True] if name == "bb" else range(5 if name == "dd" else 6)
    assert sum(math.exp(m.predictive(h, s, x)[0]) for x in values) == pytest.approx(1)


@pytest.mark.parametrize("name", list(MODELS))
def test_draws_follow_the_predictive(name):
    m, h = MODELS[name], HYPERS[name]
    s = m.from_rows(h, np.array([1, 0, 1, 3]) > 0 if name == "bb" else np.array([1, 0, 1, 3]), np.zeros(4, int), 1)
    n = 40_000
    x = m.sample(h, s, np.zeros(n, int), lambda i: hash_units(np.arange(n), 9, i))
    if name == "nich":
        mu, kappa, var, nu = (v[0] for v in m.posterior(h, s))
        assert abs(x.mean() - mu) < 0.05 and x.var() == pytest.approx(var * (kappa + 1) / kappa * nu / (nu - 2), rel=0.1)
        return
    for v, k in Counter(x.tolist()).items():
        p = math.exp(m.predictive(h, s, v)[0])
        assert abs(k / n - p) < 5 * math.sqrt(p / n) + 1e-4


def test_lgamma_and_log_sum_exp():
    x = np.array([0.01, 0.5, 1, 2.5, 8, 100, 1e6])
    assert np.allclose(lgamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)
    assert log_sum_exp(np.array([-1000.0, -1000.0])) == pytest.approx(-1000 + math.log(2))
    assert log_sum_exp(np.empty(0)) == -np.inf


def test_choose_rows_follows_the_scores():
    n = 20_000
    g = choose_rows(hash_units(np.arange(n), 1), np.tile(np.log([0.2, 0.5, 0.3]), (n, 1)))
    assert np.allclose(np.bincount(g) / n, [0.2, 0.5, 0.3], atol=0.02)


def partitions(n):
    def go(i, a):
        if i == n:
            yield tuple(a)
            return
        for g in range(max(a, default=-1) + 2):
            yield from go(i + 1, [*a, g])

    return list(go(0, []))


@pytest.mark.parametrize("alpha,d", [(2.0, 0.1), (0.5, 0.5), (1.0, 0.0)])
def test_partition_score_is_a_distribution_and_the_product_of_its_priors(alpha, d):
    total = 0.0
    for p in partitions(5):
        s = partition_score(np.bincount(p), alpha, d)
        counts, t = np.zeros(6), 0.0
        for g in p:
            at = np.append(counts[counts > 0], 0)
            prior = partition_prior(at, alpha, d)
            t += prior[g if counts[g] else len(at) - 1]
            counts[g] += 1
        assert s == pytest.approx(t, abs=1e-9)
        total += math.exp(s)
    assert total == pytest.approx(1)


def test_sampled_partitions_follow_their_score():
    rng, n = np.random.default_rng(0), 20_000
    seen = Counter(tuple(sample_partition(rng, 3, 2.0, 0.1)) for _ in range(n))
    for p in partitions(3):
        q = math.exp(partition_score(np.bincount(p), 2.0, 0.1))
        assert abs(seen[p] / n - q) < 5 * math.sqrt(q / n)


def canonical(a):
    names = {}
    return tuple(names.setdefault(g, len(names)) for g in a)


def fixed_chain(columns, models, hypers, rows, seed, kinds):
    c = cc.Chain(models, columns, rows, seed, cc.Config(infer_hypers=False, infer_kinds=kinds, extra_passes=0.0, kind_iterations=2))
    for k in c.sample.kinds:
        for f in k.features:
            c.sample.hypers[f] = hypers[f]
            k.stats[f] = MODELS[models[f]].empty(hypers[f], 1)
    return c.run()


@pytest.mark.parametrize("name,values", [("bb", [True, True, False, True]), ("nich", [0.0, 0.2, 9.0, 9.1]), ("gp", [1, 2, 30, 28])])
def test_row_gibbs_visits_partitions_by_their_probability(name, values):
    m, h, n = MODELS[name], HYPERS[name], len(values)
    v = np.array(values)
    exact = {p: partition_score(np.bincount(p), 2.0, 0.1) + m.marginal(h, m.from_rows(h, v, np.array(p), max(p) + 1)).sum() for p in partitions(n)}
    z = log_sum_exp(np.array(list(exact.values())))
    c = fixed_chain({"x": (v, np.ones(n, bool))}, {"x": name}, {"x": h}, n, 3, False)
    sweeps, seen = 4000, Counter()
    for _ in range(sweeps):
        c.sweep()
        seen[canonical(c.assign[0])] += 1
    for p, s in exact.items():
        q = math.exp(s - z)
        assert abs(seen[p] / sweeps - q) < 8 * math.sqrt(q * (1 - q) / sweeps) + 0.004


def test_kind_gibbs_joins_features_by_their_probability():
    h = {"a": HYPERS["bb"], "b": HYPERS["bb"]}
    cols = {"a": (np.array([True, True, False]), np.ones(3, bool)), "b": (np.array([True, True, False]), np.ones(3, bool))}
    like = {}
    for f in "ab":
        like[f] = {p: float(MODELS["bb"].marginal(h[f], MODELS["bb"].from_rows(h[f], cols[f][0], np.array(p), max(p) + 1)).sum()) for p in partitions(3)}
    prior = {p: partition_score(np.bincount(p), 2.0, 0.1) for p in partitions(3)}
    one = partition_score(np.array([2]), 2.0, 0.1) + log_sum_exp(np.array([prior[p] + like["a"][p] + like["b"][p] for p in prior]))
    two = partition_score(np.array([1, 1]), 2.0, 0.1) + sum(log_sum_exp(np.array([prior[p] + like[f][p] for p in prior])) for f in "ab")
    want = 1 / (1 + math.exp(two - one))
    c = fixed_chain(cols, {"a": "bb", "b": "bb"}, h, 3, 5, True)
    n = 3000
    same = 0
    for _ in range(n):
        c.sweep()
        same += len(c.sample.kinds) == 1
    assert abs(same / n - want) < 0.05


def test_chain_finds_planted_structure_and_is_reproducible():
    rng = np.random.default_rng(1)
    n = 300
    z = rng.integers(0, 2, n)
    cols = {"x": rng.normal(z * 8, 1), "y": rng.normal(z * -8, 1), "noise": rng.normal(0, 1, n)}
    cols = {f: (v, rng.random(n) < 0.9) for f, v in cols.items()}
    models = dict.fromkeys(cols, "nich")
    a, b = (cc.Chain(models, cols, n, 0, cc.Config(extra_passes=3)).run() for _ in range(2))
    assert a.log == b.log
    s, assign = a.sorted_groups()
    s.validate()
    assert s.kind_of("x") == s.kind_of("y")
    assert all((np.diff(k.counts) <= 0).all() and k.counts.sum() == n for k in s.kinds)
    assert all((np.bincount(g) == k.counts).all() for g, k in zip(assign, s.kinds))


def test_greedy_pass_keeps_kinds_and_fills_every_row():
    cols = {"x": (np.arange(50.0), np.ones(50, bool)), "y": (np.arange(50) % 3, np.ones(50, bool))}
    c = cc.Chain({"x": "nich", "y": "dd"}, cols, 50, 0, cc.Config(extra_passes=0)).run()
    assert all((a >= 0).all() for a in c.assign) and len(c.sample.kinds) == 2


def gaussian_sample(rho, n=4000):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, n)
    y = rho * x + math.sqrt(1 - rho * rho) * rng.normal(0, 1, n)
    return {"x": (x, np.ones(n, bool)), "y": (y, np.ones(n, bool))}, n


def test_relatedness_of_gaussians_grows_with_their_correlation():
    out = []
    for rho in (0.0, 0.95):
        cols, n = gaussian_sample(rho, 600)
        s = [cc.Chain({"x": "nich", "y": "nich"}, cols, n, 1, cc.Config(extra_passes=10)).run().sorted_groups()[0].with_empty()]
        e = cc.entropies(s, [frozenset("x"), frozenset("y"), frozenset("xy")], {}, 2000, 0)
        out.append(cc.relatedness(cc.mutual_information(e, frozenset("x"), frozenset("y")).mean))
    assert out[0] < 0.25 and 0.85 < out[1] < 1


def test_score_of_nothing_is_zero_and_draws_keep_conditions_apart():
    cols, n = gaussian_sample(0.9, 400)
    s = [cc.Chain({"x": "nich", "y": "nich"}, cols, n, k, cc.Config(extra_passes=2)).run().sorted_groups()[0].with_empty() for k in range(2)]
    assert cc.ensemble_score(s, {}, 3).tolist() == [0, 0, 0]
    d = {v: cc.draw(s, {"x": (np.array([v]), np.array([True]))}, 1, ["y"], 500, np.array([0]))["y"].mean() for v in (-2.0, 2.0)}
    assert d[-2.0] < d[2.0]
    with pytest.raises(ValueError):
        cc.entropies(s, [frozenset("x")], {}, 1, 0)
    after = cc.add_row(s[0], {"x": 1.0, "y": None}, np.random.default_rng(0))
    assert after.rows == s[0].rows + 1 and s[0].rows == n
    assert cc.relatedness(50.0) < 1


@pytest.mark.parametrize("make", [grids.uniform, grids.center_heavy, grids.left_heavy, grids.right_heavy])
def test_grids_stay_within_their_ends(make):
    rng = np.random.default_rng(0)
    for _ in range(100):
        lo, hi = sorted(np.arctan(np.pi * (rng.random(2) - 0.5)))  # negative ends too
        g = make(lo, hi, int(rng.integers(1, 100)))
        assert (g >= lo - 1e-9).all() and (g <= hi + 1e-9).all() and (np.diff(g) > 0).all()
    pairs = grids.pitman_yor()
    assert len(pairs) == 137 and all(0.1 <= a <= 100 and 0 <= d < 0.5 for a, d in pairs)


def test_schedule_of_actions():
    seen = Counter()
    for what, first, last in schedules.actions(2000, 4.0):
        seen[what] += last - first
    assert seen["add"] - seen["remove"] == 2000 and seen["add"] / 2000 == pytest.approx(5, rel=0.01)
    assert {w for w, _, _ in schedules.actions(50, 0.0)} == {"add"} and not list(schedules.actions(0, 1.0))
    assert schedules.extra_passes(100) == 500 and schedules.extra_passes(10**9) == 0 and 0 < schedules.extra_passes(10**6) < 500


@pytest.mark.parametrize("grain", [0.0, 0.125, 0.9])
def test_actions_never_remove_what_is_not_in(grain):
    head = tail = 0
    for what, first, last in schedules.actions(500, 3.0, grain):
        if what == "add":
            assert first == head and last > first
            head = last
        elif what == "remove":
            assert first == tail and last <= head
            tail = last
    assert head - tail == 500


@pytest.mark.parametrize("name", list(MODELS))
def test_rows_taken_out_in_blocks_leave_the_statistics_of_the_rest(name):
    m, h = MODELS[name], HYPERS[name]
    v, g = np.array([1, 0, 1, 3, 2, 2, 0, 1]), np.array([0, 1, 1, 0, 1, 0, 2, 2])
    v = v > 0 if name == "bb" else v
    rest = m.less(m.from_rows(h, v, g, 3), m.from_rows(h, v[:5], g[:5], 3))
    for f, want in m.from_rows(h, v[5:], g[5:], 3).items():
        assert np.allclose(rest[f], want)


@pytest.mark.parametrize("name", ["bb", "gp", "nich"])
def test_grid_scores_are_marginals(name):
    m, h = MODELS[name], HYPERS[name]
    s = m.from_rows(h, np.array([1, 0, 1, 3]) > 0 if name == "bb" else np.array([1, 0, 1, 3]), np.array([0, 0, 1, 1]), 2)
    for n, points in m.grid(h).items():
        want = [m.marginal({**h, n: float(p)}, s).sum() for p in points]
        assert np.allclose(m.grid_scores(h, n, points, s), want)


def test_blocks_of_rows_find_the_groups_that_single_rows_find():
    z = np.repeat([0, 1, 2], 80)
    v = np.random.default_rng(0).normal(z * 20, 1)
    for grain in (0.0, 0.0625, 0.25):
        s, (a,) = cc.Chain({"x": "nich"}, {"x": (v, np.ones(240, bool))}, 240, 4, cc.Config(extra_passes=8, grain=grain, infer_hypers=False)).run().sorted_groups()
        assert all((a[z == k] == np.bincount(a[z == k]).argmax()).mean() > 0.95 for k in range(3)) and s.kinds[0].counts[:3].min() > 70


def test_samples_survive_their_plain_form():
    cols, n = gaussian_sample(0.5, 50)
    s = cc.Chain({"x": "nich", "y": "nich"}, cols, n, 1).run().sorted_groups()[0]
    t = cc.Sample.from_state(s.state())
    assert t.log_likelihood() == s.log_likelihood() and list(product(*[range(2)] * 2))


def test_draws_and_kind_changes():
    cols, n = gaussian_sample(0.9, 40)
    c = cc.Chain({"x": "nich", "y": "nich"}, cols, n, 1).run()
    draws = list(cc.posterior_draws(c, 3, 1))
    assert len(draws) == 3 and all(k.counts.sum() == n for s, _ in draws for k in s.kinds)
    one, two = (cc.Sample({"x": "nich", "y": "nich"}, {}, [cc.Kind(f, 1, 0, np.zeros(1), {}) for f in fs]) for fs in ([["x", "y"]], [["x"], ["y"]]))
    assert cc.kind_changes(one, two) == {"born": 2, "gone": 1, "changed": 2} and cc.kind_changes(one, one)["changed"] == 0


@pytest.mark.parametrize("distinct", [1, 3, 1000])
def test_rows_with_equal_values_draw_as_if_scored_alone(distinct):
    n = 500
    rng = np.random.default_rng(0)
    cols = {"x": (rng.integers(0, distinct, n).astype(float), rng.random(n) < 0.9), "y": (rng.integers(0, distinct, n) % 5, np.ones(n, bool))}
    s = cc.Chain({"x": "nich", "y": "gp"}, cols, n, 1).run().sorted_groups()[0].with_empty()
    u = hash_units(np.arange(n), 4)
    for k in range(len(s.kinds)):
        assert (s.draw_groups(k, cols, n, u) == choose_rows(u, s.group_scores(k, cols, n))).all()
        assert len(s.draw_groups(k, {f: (v[:0], o[:0]) for f, (v, o) in cols.items()}, 0, u[:0])) == 0

"""Kernels against closed forms, hand-worked cases and known tables."""

import math

import numpy as np
import pytest

from kinetrace.functions import kernels as K
from kinetrace.functions import tails as T


def test_tails_match_tables():
    assert T.normal_sf(1.959964) == pytest.approx(0.025, abs=1e-6)
    assert T.t_sf2(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert T.f_sf(4.102821, 2, 10) == pytest.approx(0.05, abs=1e-6)
    assert T.chi2_sf(5.991465, 2) == pytest.approx(0.05, abs=1e-6)
    assert T.digamma(np.array([1.0]))[0] == pytest.approx(-0.5772156649, abs=1e-9)
    assert T.normal_ppf(0.975) == pytest.approx(1.959964, abs=1e-6)


def test_shapiro_on_published_sample():
    # Weights of men (Shapiro and Wilk 1965): W = 0.79.
    x = np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236.0])
    w, p = K.shapiro_wilk(x)
    assert w == pytest.approx(0.79, abs=0.005) and p < 0.02


def test_one_class_rejects_about_nu():
    x = np.random.default_rng(1).normal(size=(200, 3))
    m = K.OneClass(0.2).fit(x)
    assert abs((m.decision(x) < 0).mean() - 0.2) < 0.05
    assert (m.decision(x + 20) < 0).all()
    assert m.alpha.sum() == pytest.approx(1)


def test_change_point_is_found():
    x = np.r_[np.zeros(20), np.ones(20) * 5] + np.random.default_rng(2).normal(size=40) * 0.1
    assert K.change_points(x) == [20]
    assert K.change_points(np.random.default_rng(3).normal(size=40), penalty=100.0) == []


def test_change_points_against_all_partitions():
    rng = np.random.default_rng(4)
    for _ in range(20):
        x = rng.normal(size=9) + np.repeat(rng.normal(size=3) * 3, 3)
        pen = math.log(9) * x.var()
        best = None
        for mask in range(1 << 8):
            ends = [i + 1 for i in range(8) if mask >> i & 1]
            cuts = [0, *ends, 9]
            if min(np.diff(cuts)) < 2:
                continue
            cost = sum(((x[a:b] - x[a:b].mean()) ** 2).sum() for a, b in zip(cuts, cuts[1:], strict=False)) + pen * len(ends)
            if best is None or cost < best[0] - 1e-9:
                best = cost, ends
        assert K.change_points(x) == best[1]


def test_lof_finds_the_far_value():
    x = np.r_[np.linspace(0, 1, 30), 50.0]
    f = K.local_outlier_factor(x)
    assert f.argmax() == 30 and f[30] > 2 and (f[:30] < 2).all()


def test_isolation_decision_orders_values():
    x = np.r_[np.random.default_rng(5).normal(size=100), 30.0]
    d = K.isolation_scores(x)
    assert d.argmin() == 100 and (d > -0.5).all()


def test_modes_and_bootstrap():
    rng = np.random.default_rng(6)
    assert K.density_modes(rng.normal(size=300)) == 1
    assert K.density_modes(np.r_[rng.normal(size=200), rng.normal(size=200) + 10]) == 2
    low, high = K.bootstrap_median(np.arange(101.0))
    assert low < 50 < high


def test_normality_tests_tell_normal_from_exponential():
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=200), rng.exponential(size=200)
    assert not K.anderson_darling(a)[1] and K.anderson_darling(b)[1]
    assert K.cramer_von_mises(a)[1] > 0.05 > K.cramer_von_mises(b)[1]
    assert K.shapiro_wilk(a)[1] > 0.05 > K.shapiro_wilk(b)[1]
    assert K.lilliefors_p(K.kolmogorov_smirnov(b)[0], 200) < 0.01


def test_relevance_kernels_prefer_the_telling_feature():
    rng = np.random.default_rng(8)
    y = np.repeat([0, 1], 60)
    x = np.c_[y * 3 + rng.normal(size=120), rng.normal(size=120)]
    assert K.knn_information(x[:, 0], y) > 0.3 > K.knn_information(x[:, 1], y)
    r = K.relief(x, y)
    assert r[0] > r[1]
    assert (K.laplacian_scores(x) <= 1).all()


def test_signals():
    t = np.arange(0, 16, 1 / 16)
    d = K.spectrum_descriptors(np.sin(2 * np.pi * 3 * t), 16)
    assert d["peak"] == pytest.approx(3, abs=0.1) and d["high"] > d["low"]
    assert np.allclose(K.tapers(50) @ K.tapers(50).T, np.eye(3), atol=1e-9)
    flat = K.low_pass(np.sin(2 * np.pi * 6 * t) + 1, 16, 0.5)
    assert np.allclose(flat[40:-40], 1, atol=0.05)
    a, dd = K.wavelet_level(np.ones(64))
    assert np.allclose(dd, 0, atol=1e-9) and np.allclose(a, math.sqrt(2), atol=1e-9)
    tau = np.linspace(0, 1, 50)
    s = 10 * tau**3 - 15 * tau**4 + 6 * tau**5
    assert K.minimum_jerk(tau * 400, 100 * s, 50 * s)["deviation"] < 0.01
    assert len(K.cepstrum(np.sin(t), 16)) == 6


def test_shapley_of_a_linear_score():
    x, b = np.eye(3), np.zeros((1, 3))
    s = K.sampled_shapley(lambda v: v @ np.array([3.0, 2.0, 1.0]), x, b, 5)
    assert np.allclose(s, [1, 2 / 3, 1 / 3])


def test_importance_and_bootstrap_take_all_rows(spark):
    import pandas as pd

    from kinetrace.functions import kernels as K
    from kinetrace.operators import grouped as G

    rng = np.random.default_rng(7)
    df = pd.DataFrame({"user_id": 1, "genuine": np.r_[np.ones(150, int), np.zeros(350, int)], "a": rng.normal(size=500), "b": rng.normal(size=500)}).sort_values(["a", "b", "genuine"])
    x, y = df[["a", "b"]].to_numpy(), df.genuine.to_numpy()
    fit, every = K.scaled(x[y == 1], x)
    want = K.permutation_importance(K.OneClass(0.2).fit(fit), every, y, 50)
    got = {r.feature: r.permutation for r in G.importance(spark.createDataFrame(df), ["a", "b"]).collect()}
    assert np.allclose([got["a"], got["b"]], want)
    v = rng.exponential(size=40)
    r = G.distribution_kernels(spark.createDataFrame(pd.DataFrame({"k": 1, "pos": range(40), "value": v})), ["k"]).first()
    assert np.allclose((r.median_low, r.median_high), K.bootstrap_median(v, 1000))


def test_neighbour_information_needs_no_matrix_of_all_pairs():
    rng = np.random.default_rng(9)
    x, y = np.round(rng.normal(size=90), 1), (rng.random(90) < 0.6).astype(int)
    total = 0.0
    for c in (0, 1):
        own = np.flatnonzero(y == c)
        d = np.abs(x[own][:, None] - x[None])
        radius = np.nextafter(np.sort(d[:, own], axis=1)[:, 3], 0)
        total += (T.digamma(np.array([3.0]))[0] - T.digamma(np.array([float(len(own))]))[0]) * len(own) - T.digamma((d <= radius[:, None]).sum(1).astype(float)).sum()
    assert K.knn_information(x, y) == pytest.approx(max(0.0, T.digamma(np.array([90.0]))[0] + total / 90))
    import tracemalloc

    x = rng.normal(size=6000)
    tracemalloc.start()
    K.knn_information(x, (x > 0).astype(int))
    assert tracemalloc.get_traced_memory()[1] < 20e6  # a matrix of a class against all takes 144 MB
    tracemalloc.stop()


def test_neighbours_with_ties_and_relief():
    rng = np.random.default_rng(10)
    d = rng.integers(0, 5, (40, 30)).astype(float)
    want = np.zeros(d.shape, dtype=bool)
    np.put_along_axis(want, np.argsort(d, axis=1, kind="stable")[:, :7], True, axis=1)
    assert (K.nearest_marks(d, 7) == want).all()
    x, y = rng.integers(0, 4, (50, 2)).astype(float), rng.integers(0, 2, 50)
    z, out = x / 3, np.zeros(2)
    far = np.abs(z[:, None] - z[None]).sum(2)
    for i in range(50):
        for same, sign in ((True, -1), (False, 1)):
            own = [j for j in np.flatnonzero((y == y[i]) == same) if j != i]
            near = sorted(own, key=lambda j: (far[i, j], j))[:10]
            out += sign * np.abs(z[near] - z[i]).mean(0) / 50
    assert np.allclose(K.relief(x, y), out)


def test_permutations_do_not_score_anew(monkeypatch):
    x = np.random.default_rng(11).normal(size=(60, 3))
    y = (np.arange(60) % 3 > 0).astype(int)
    model, calls = K.OneClass(0.2).fit(x[y == 1]), []
    rng, base, want = np.random.default_rng(42), K.array_auc(model.decision(x), y), np.zeros(3)
    for f in range(3):
        for _ in range(5):
            z = x.copy()
            z[:, f] = rng.permutation(z[:, f])
            want[f] += (base - K.array_auc(model.decision(z), y)) / 5
    decision = K.OneClass.decision
    monkeypatch.setattr(K.OneClass, "decision", lambda self, v: calls.append(1) or decision(self, v))
    assert np.allclose(K.permutation_importance(model, x, y, 5), want) and len(calls) == 1


def test_isolation_trees_draw_once_a_tree(monkeypatch):
    calls, make = [], np.random.default_rng

    class Counted:
        def __init__(self, seed):
            self.r = make(seed)
            self.bit_generator = self.r.bit_generator

        def __getattr__(self, name):
            calls.append(name)
            return getattr(self.r, name)

    x = make(12).normal(size=67)
    want = K.isolation_scores(x)
    monkeypatch.setattr(np.random, "default_rng", Counted)
    assert np.array_equal(K.isolation_scores(x), want) and len(calls) <= 3 * 50


def test_stored_models_score_a_users_rows_together(spark):
    from kinetrace.operators import grouped as G
    from kinetrace.streaming import sessions as S

    import pandas as pd

    rng = np.random.default_rng(13)
    rows = spark.createDataFrame(pd.DataFrame({"user_id": np.repeat([1, 2, 3], 20), "pos": range(60), "genuine": [1] * 40 + [0] * 20, "a": rng.normal(size=60), "b": rng.normal(size=60)}))
    out = S.model_scores(rows, G.model_table(rows, ["a", "b"]), ["a", "b"])
    got = {r.pos: r.score for r in out.collect()}
    assert sorted(got) == list(range(40)) and "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    x = np.array([(r.a, r.b) for r in sorted(rows.where("user_id = 2").collect(), key=lambda r: (r.a, r.b))])
    at = [r.pos for r in sorted(rows.where("user_id = 2").collect(), key=lambda r: (r.a, r.b))]
    fit = K.scaled(x)[0]
    assert np.allclose([got[p] for p in at], K.OneClass(0.2).fit(fit).decision(fit))

import math

import numpy as np
import pytest

from braidview.functions import autodiff as ad
from braidview.functions import constraints, gram, linalg, steps
from braidview.operators import columns

RNG = np.random.default_rng(7)


def test_defects_of_identity_and_equal_columns():
    eye = np.eye(4)
    s = linalg.orthogonality_summary(eye)
    assert s["invariant_defect"] == s["stiefel_defect"] == s["mean_defect"] == 0.0 and s["condition_number"] == 1.0
    assert linalg.mean_defect(np.ones((4, 2))) > 0.9


def test_defect_gradients():
    a = RNG.standard_normal((5, 3))
    got, want = linalg.mean_defect_gradient(a), np.zeros_like(a)
    for i in np.ndindex(a.shape):
        b = a.copy()
        b[i] += 1e-6
        want[i] = (linalg.mean_defect(b) - linalg.mean_defect(a)) / 1e-6
    assert np.allclose(got, want, atol=1e-4)


def test_rv_and_procrustes():
    x = RNG.standard_normal((50, 3))
    turn = linalg.polar(RNG.standard_normal((3, 3)))
    assert linalg.rv(x, x @ turn * 3) == pytest.approx(1.0)
    assert linalg.procrustes_r2(x, x @ turn * 3 + 1) == pytest.approx(1.0)
    assert linalg.procrustes_mse(x, x @ turn) == pytest.approx(0.0, abs=1e-12)
    assert linalg.rv(x, np.zeros((50, 2))) == 0.0


def test_distribution_functions():
    assert linalg.t_cdf(2.0, 10) == pytest.approx(0.963306, abs=1e-6)
    assert linalg.f_sf(4.0, 2, 20) == pytest.approx(0.0345716, abs=1e-6)
    assert linalg.welch_t([1, 2, 3, 4], [1, 2, 3, 4])[2] == pytest.approx(1.0)


def test_newton_schulz_and_pca():
    x = 0.3 * RNG.standard_normal((20, 3))
    assert linalg.stiefel_defect(linalg.newton_schulz(x / np.linalg.norm(x), 40)) < 1e-6
    scores, loadings, s = linalg.pca(np.column_stack([x, np.ones(20)]), 2)
    assert not loadings[3].any() and s[0] >= s[1] and scores.shape == (20, 2)
    assert not linalg.pca(np.ones((5, 2)))[0].any()


def test_constraints():
    assert constraints.parse_constraint("orthox0.1x2") == constraints.Constraint("ortho", 0.1, 2)
    assert constraints.parse_constraint("Stiefel").weight == 1.0
    v = RNG.standard_normal((10, 3))
    p = constraints.orthonormal_nonnegative(v)
    assert p.min() >= -1e-7
    assert not constraints.orthogonal_sparse(np.zeros((4, 2))).any()
    hard = constraints.threshold_columns(v, 0.5, soft=False)
    assert ((hard != 0).sum(axis=0) == 5).all()
    soft = constraints.threshold_columns(v, 0.3)
    j = 0
    cut = np.quantile(np.abs(v[:, j]), 0.3)
    assert np.allclose(soft[:, j], np.sign(v[:, j]) * (np.abs(v[:, j]) - cut).clip(min=0))
    assert (constraints.indicator(v).sum(axis=0) == 1).all()
    assert ((constraints.segment_by_rank(v, 0.5, basic=True, sign="either") != 0).sum(axis=1) == round(3 * 0.5)).all()
    for kind in ("Stiefel", "Grassmann_polar", "NewtonSchulz", "ortho", "nsaflow", "none"):
        assert constraints.constrain(v, constraints.Constraint(kind, 0.5, 2), 0.2, "positive").shape == v.shape
    g = constraints.tangent(v, linalg.polar(v), "Grassmann")
    assert np.allclose(linalg.polar(v).T @ g, 0)


def test_every_step_rule_lowers_a_quadratic():
    target = RNG.standard_normal((6, 2))
    cost = lambda v: float(((v - target) ** 2).sum())
    for name in steps.RULES:
        if name == "nsa_flow":
            continue
        rule, v = steps.make_step(name), np.ones((6, 2))
        for _ in range(30):
            v = rule(0, v, 2 * (target - v), cost)
        assert cost(v) < cost(np.ones((6, 2))), name
    with pytest.raises(ValueError, match="unknown"):
        steps.make_step("unknown")
    turned = steps.make_step("nsa_flow")(0, linalg.polar(target), target)
    assert linalg.stiefel_defect(turned) < 1e-8


def moments_of(*views):
    xs = [x - x.mean(axis=0) for x in views]
    all_ = np.hstack(xs)
    return gram.Moments(all_.T @ all_, [0, *np.cumsum([x.shape[1] for x in xs]).tolist()], len(all_)), xs


@pytest.mark.parametrize("mixer", ["avg", "newton", "svd", "pca"])
def test_moment_form_equals_rows(mixer):
    m, xs = moments_of(RNG.standard_normal((80, 6)), RNG.standard_normal((80, 5)), RNG.standard_normal((80, 4)))
    bases = [RNG.standard_normal((x.shape[1], 2)) for x in xs]
    unit = [x @ v / (math.sqrt(((x @ v) ** 2).sum() / 80) + 1e-8) for x, v in zip(xs, bases)]
    if mixer in ("avg", "newton"):
        u = np.mean(unit, axis=0)
        u = linalg.newton_schulz(u, 10) if mixer == "newton" else u
    else:
        big = np.hstack(unit)
        u = big @ linalg.canonical_sign(np.linalg.svd(big, full_matrices=False)[2].T[:, :2])
    u = u - u.mean(axis=0)
    u = u / (u.std(axis=0, ddof=1) + 1e-6)
    s = gram.consensus(m, bases, mixer)[0]
    got = np.hstack(xs) @ s.stacked()
    assert np.allclose(np.abs(got), np.abs(u), atol=1e-8)
    assert gram.energy(m, 0, bases[0], s, "regression") == pytest.approx(((xs[0] - got @ bases[0].T) ** 2).sum())
    assert gram.energy(m, 1, bases[1], s, "acc") == pytest.approx(-np.abs(got.T @ xs[1] @ bases[1]).sum() / 79)
    w = gram.reconstruction_map(m, 2, s)
    assert np.allclose(w, np.linalg.pinv(got) @ xs[2])
    assert gram.reconstruction_error(m, 2, s, w) == pytest.approx(np.linalg.norm(xs[2] - got @ w) / np.linalg.norm(xs[2]))


def test_descent_directions():
    m, xs = moments_of(RNG.standard_normal((60, 5)), RNG.standard_normal((60, 4)))
    u, v = gram.only(m, 1, RNG.standard_normal((4, 2))), RNG.standard_normal((5, 2))
    for kind in ("acc", "nc", "logcosh", "exp", "gauss", "kurtosis"):
        small = 1e-3 if kind != "nc" else 1.0
        way = gram.downhill(m, 0, v * small, u, kind)
        before, after = (gram.energy(m, 0, v * small + e * way / np.linalg.norm(way), u, kind) for e in (0.0, 1e-6))
        assert after <= before + 1e-9, kind


def test_topologies_and_pruning():
    base = RNG.standard_normal((100, 3))
    views = [base + 0.01 * RNG.standard_normal((100, 3)) for _ in range(3)] + [RNG.standard_normal((100, 3))]
    m, _ = moments_of(*views)
    bases = [np.eye(3)[:, :2]] * 4
    assert len(gram.consensus(m, bases, "avg", "loo")) == 4
    assert len(gram.consensus(m, bases, "avg", "graph", {0: [1], 1: [0], 2: [], 3: [0]})) == 4
    pruned = gram.consensus(m, bases, "avg", prune=0.5)[0]
    assert not pruned.maps[3].any() and pruned.maps[0].any()
    with pytest.raises(ValueError):
        gram.consensus(m, bases, "avg", "graph")


def test_names():
    names = ["apple", "banana", "cherry", "date", "eggplant"]
    assert columns.match_positions(["a", "e"], names) == [0, 1, 2, 3, 4]
    assert columns.match_positions(["a", "e"], names, every=True) == [0, 3, 4]
    assert columns.names_of_any(["an", "ch"], names, "ban") == ["cherry", "eggplant"]
    short = ["t1.left-caudate.vol", "dti.fa.left", "cbf.right", "rsf.p2"]
    assert [columns.shorten_name(x) for x in ("T1Hier_Left-Caudate_volume", "DTI_mean_fa_Left", "perf_cbf_mean_Right", "rsfMRI_fcnxpro129")] == short
    assert columns.versioned("t1_PC1", {"t1_PC1"}) == "t1_PCr00.11"
    assert columns.versioned("x", {"x", *[f"xr00.{k}" for k in range(1, 10)]}) == "xr01.1"
    table = ["T1Hier_Left-Caudate_vol", "T1Hier_Right-Caudate_vol", "SNR", "hier_id", "unrelated", "DTI_mean_fa_Left", "T1Hier_Left-Caudate_tissues"]
    assert columns.imaging_predictors(table) == ["T1Hier_Left-Caudate_vol", "T1Hier_Right-Caudate_vol", "DTI_mean_fa_Left"]


def test_autodiff():
    w, b, x = RNG.standard_normal((4, 3)), RNG.standard_normal((1, 3)), RNG.standard_normal((6, 4))

    def f(w, b):
        h = ad.layer_norm(ad.var(x) @ w, b, b * 0.5)
        z = ad.concat([ad.tanh(h) * ad.exp(h * 0.1) + ad.softplus(h), ad.logcosh(h)])
        return (z[:, :3] ** 2).mean() + ad.sqrt((z * z).sum()) + ad.absolute(z).mean() + ad.log((z * z).sum() + 1.0)

    p = ad.Var(w), ad.Var(b)
    f(*p).backward()
    for k, v in enumerate((w, b)):
        for i in np.ndindex(v.shape):
            up, down = v.copy(), v.copy()
            up[i] += 1e-6
            down[i] -= 1e-6
            args = lambda y: [ad.Var(y if n == k else o) for n, o in enumerate((w, b))]
            assert p[k].g[i] == pytest.approx((f(*args(up)).x - f(*args(down)).x) / 2e-6, abs=1e-5)


def test_every_named_step_lowers_a_quadratic():
    target = np.linspace(-1.0, 1.0, 12).reshape(6, 2)
    energy = lambda v: float(((v - target) ** 2).sum())
    assert steps.list_steps() == sorted(steps.RULES) and {"random_search", "ls_nadam", "psgd", "ranger"} <= set(steps.list_steps())
    start = linalg.polar(np.random.default_rng(1).standard_normal((6, 2)))
    for name in steps.list_steps():
        for given in (energy, None):
            if given is None and name in ("random_search", "random_gradient"):
                continue  # they know no better move without it
            rule, v = steps.make_step(name, learning_rate=0.05), start.copy()
            for _ in range(60):
                v = rule(0, v, 2 * (target - v), given)
            assert np.isfinite(v).all() and energy(v) < energy(start), (name, given)
        assert rule(1, start, target - start, None).shape == start.shape


def test_searched_steps_never_go_uphill():
    target = np.arange(8.0).reshape(4, 2)
    energy = lambda v: float(((v - target) ** 2).sum())
    for name in ("ls_adam", "ls_rmsprop", "ls_nadam", "random_search", "random_gradient"):
        rule, v = steps.make_step(name), np.zeros((4, 2))
        for _ in range(25):
            after = rule(0, v, 2 * (target - v), energy)
            assert energy(after) <= energy(v), name
            v = after


def test_agreement_needs_moments_alone():
    from braidview.plans import neural

    rng = np.random.default_rng(5)
    u = rng.standard_normal((40, 3))
    views = [u + 0.3 * i * rng.standard_normal((40, 3)) for i in range(4)]
    for metric in neural.AGREEMENT:
        got = neural.agreement(views, metric)
        for i, z in enumerate(views):
            unit = lambda x: (x - x.mean(axis=0)) / np.linalg.norm(x - x.mean(axis=0))
            z, rest = unit(z), unit(sum(unit(x) for j, x in enumerate(views) if j != i))
            best = linalg.procrustes_r2(z, rest) if metric.startswith("procrustes") else None
            if best is not None and metric == "procrustes_r2":
                assert got[i] == pytest.approx(max(0.0, 1 - np.linalg.norm(z @ linalg.polar(z.T @ rest) - rest) ** 2), abs=1e-6)
            if metric == "trace":
                assert got[i] == pytest.approx(max(0.0, np.trace(z.T @ rest)), abs=1e-9)
        assert neural.agreement(views[:1], metric) == [1.0]

"""Kernels against closed forms, optimality conditions and held-out accuracy."""

import tracemalloc
from dataclasses import replace

import numpy as np
import pytest

from assayline.config import Config
from assayline.operators.evaluate import evaluate, feature_count, screened, select
from assayline.operators.kernels import base, linear, registry, similarity, trees
from assayline.operators.kernels.base import Gram, Task, backward, cholesky, forward, kernel_product, solve_shifted, squared_distances


def made(n):
    rng = np.random.default_rng(0)
    t = rng.normal(size=(n, 3))
    return t @ rng.normal(size=(3, 20)) + 0.05 * rng.normal(size=(n, 20)), 20 + 3 * t[:, 0] - 2 * t[:, 1] + 0.2 * rng.normal(size=n)


@pytest.fixture(scope="module")
def data():
    return made(48)


AXIS = np.array([200 + 2.5 * i for i in range(20)])
FAST = Config(level="fast", inner_repeats=1, inner_folds=3)


@pytest.mark.parametrize("name", [n for n in registry.KERNELS] + ["WeightedStacking"])
def test_held_out_accuracy(name):
    n = 120 if name == "HistGBR" else 48  # leaves of 20 rows need some
    x, y = made(n)
    got = evaluate(x, y, np.arange(n) % 4 != 0, "RAW", "raw", name, AXIS, FAST, (name,))
    assert got["error"] is None, got["error"]
    assert got["Rp2"] > 0.6 and got["RPD"] == pytest.approx(1 / np.sqrt(1 - got["Rp2"]))


def test_missing_library_is_an_error_row(data):
    x, y = data
    for name in registry.OPTIONAL:
        if not registry.available(name):
            got = evaluate(x, y, np.arange(48) % 4 != 0, "RAW", "raw", name, AXIS, FAST, (name,))
            assert "not installed" in got["error"] and "Rp2" not in got


def test_pls_with_all_components_is_least_squares(data):
    x, y = data
    b, scale, mean, _ = linear.pls_path(x, y, 20)
    z = scale(x)
    np.testing.assert_allclose(z @ b[-1] + mean, np.linalg.lstsq(np.column_stack([z, np.ones(48)]), y, rcond=None)[0] @ np.column_stack([z, np.ones(48)]).T, atol=1e-6)


def test_ridge_closed_form(data):
    x, y = data
    c = x - x.mean(0)
    w = np.linalg.solve(c.T @ c + 2.5 * np.eye(20), c.T @ (y - y.mean()))
    np.testing.assert_allclose(linear.ridge_path(x, y, x, np.array([2.5]))[0], c @ w + y.mean())


def test_lasso_optimality(data):
    x, y = data
    s = (x - x.mean(0)) / x.std(0)
    w, mean = linear.elastic_path(s, y, np.array([0.1]), np.array([1.0]), rounds=20000, tol=1e-10)
    g = s.T @ (y - mean - s @ w[:, 0]) / len(y)
    assert np.abs(g).max() <= 0.1 + 1e-4
    on = np.abs(w[:, 0]) > 1e-8
    np.testing.assert_allclose(g[on], 0.1 * np.sign(w[on, 0]), atol=1e-4)


def test_svr_tube():
    x = np.linspace(0, 1, 30)[:, None]
    y = 2 * x[:, 0] - 1
    beta, b = similarity.svr_dual(x @ x.T, y, 100.0, 0.05, rounds=5000)
    assert np.abs(x @ x.T @ beta + b - y).max() < 0.06 and abs(beta.sum()) < 0.5


@pytest.mark.parametrize("rbf,c,eps", [(rbf, c, eps) for rbf in (False, True) for c in (0.3, 3.0, 30.0) for eps in (0.02, 0.1)])
def test_svr_optimality(rbf, c, eps):
    """At the settings of the search: within the tube without weight, at its edge with some, beyond it with all."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 40))
    y = x[:, 0] - 0.5 * x[:, 1] + 0.3 * rng.normal(size=60)
    y = (y - y.mean()) / y.std()
    k = np.exp(-0.01 * ((x[:, None] - x[None]) ** 2).sum(-1)) if rbf else x @ x.T
    beta, b = similarity.svr_dual(k, y, c, eps)
    r = y - k @ beta - b
    size, tol = np.abs(beta), 5e-3
    assert abs(beta.sum()) < 1e-2 * max(1, size.max()) and size.max() <= c
    free = (size > 1e-6 * c) & (size < c * (1 - 1e-6))
    assert (np.abs(r[size <= 1e-6 * c]) <= eps + tol).all()
    assert (np.abs(r[free] - eps * np.sign(beta[free])) <= tol).all()
    assert (r[size >= c * (1 - 1e-6)] * np.sign(beta[size >= c * (1 - 1e-6)]) >= eps - tol).all()


def test_stack_of_six(data):
    x, y = data
    got = evaluate(x, y, np.arange(48) % 4 != 0, "RAW", "raw", "STACKING", AXIS, FAST, ("s",))
    assert got["error"] is None and got["Rp2"] > 0.6


def test_number_of_channels_is_tuned(data):
    x, y = data
    tuned = Config(level="fast", inner_repeats=1, inner_folds=3, feature_candidates=(2, 6, 12, 20, 50), feature_min=4)
    k = feature_count(x, y, "RAW", "raw", AXIS, tuned, 1)
    assert k in (6, 12, 20) and feature_count(x, y, "RAW", "raw", AXIS, FAST, 1) == 158
    got = evaluate(x, y, np.arange(48) % 4 != 0, "RAW", "raw", "PLS", AXIS, tuned, ("s",))
    assert len(got["channels"]) in (6, 12, 20)


def test_calibration_screen(data):
    x, y = data
    bad = y.copy()
    bad[5] += 40
    keep = screened(x, bad, Config(mccv_iterations=40, max_pls_components=3), 7)
    assert not keep[5] and keep.sum() >= 41 and screened(x[:10], bad[:10], Config(), 7).all()


def test_tree_fits_steps():
    x = np.arange(20.0)[:, None]
    y = (x[:, 0] >= 10).astype(float)
    t = trees.Tree(3, 2).fit(x, y, np.random.default_rng(0))
    np.testing.assert_allclose(t.predict(x), y)


def test_selection():
    s = np.array([0.1, 0.9, 0.9, 0.2])
    assert select(s, 2, False).tolist() == [1, 2] and select(s, 2, True).tolist() == [1, 2] and select(np.array([1.0, 1.0, 1.0]), 2, False).tolist() == [1, 2]


def test_ineligible_transform(data):
    x, y = data
    assert "log1p" in evaluate(x, y - 100, np.arange(48) % 4 != 0, "RAW", "log1p", "PLS", AXIS, FAST, ())["error"]


def test_solvers_by_blocks():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(700, 5)), rng.normal(size=(700, 2))
    k = np.exp(-0.1 * squared_distances(x, x)) + 0.3 * np.eye(700)
    low = cholesky(np.tril(k))
    assert np.allclose(np.tril(low), np.linalg.cholesky(k), atol=1e-10)
    assert np.allclose(backward(low, forward(low, y)), np.linalg.solve(k, y), atol=1e-10)
    assert np.allclose(kernel_product(x[:300], x, lambda d: np.exp(-d), y), np.exp(-squared_distances(x[:300], x)) @ y)
    with pytest.raises(np.linalg.LinAlgError):
        cholesky(k - 2 * np.eye(700))


@pytest.mark.parametrize("name", ["KRR-RBF", "RBF-LS-SVM", "PLS-LSSVM", "GPR-SE", "SVR-Linear", "KNN"])
def test_no_solver_takes_a_whole_kernel(name, monkeypatch):
    """No kernel matrix of all rows is decomposed, solved or sorted at once."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 6))
    y = 20 + x @ rng.normal(size=6) + 0.1 * rng.normal(size=400)
    largest = {"solve": 0, "eigh": 0, "argsort": 0}

    def watched(module, what):
        real = getattr(module, what)

        def run(a, *rest, **named):
            if np.ndim(a) == 2:
                largest[what] = max(largest[what], np.shape(a)[0])
            return real(a, *rest, **named)

        monkeypatch.setattr(module, what, run)

    watched(np.linalg, "solve"), watched(np.linalg, "eigh"), watched(np, "argsort")
    if name == "GPR-SE":
        monkeypatch.setattr(similarity, "_simplex", lambda f, start: min((start, start + 0.5), key=f))
    cfg = replace(Config(), level="fast", inner_repeats=1)
    predict = registry.fit(name, Task(x, y, "raw", cfg, 1))
    assert np.isfinite(predict(x)).all() and largest["solve"] <= 256 and not largest["eigh"] and not largest["argsort"]


def test_svr_options_together():
    """Options that step together end where each ends alone, also along a kernel's rank only."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 4))
    y = x @ rng.normal(size=4) + 0.05 * rng.normal(size=60)
    q, s, _ = np.linalg.svd(x, full_matrices=False)
    c, eps = np.array([0.3, 3.0, 30.0]), np.array([0.03, 0.1, 0.03])
    beta, b = similarity.svr_duals(s * s, q, y, c, eps)
    for i in range(3):
        one, bias = similarity.svr_dual(x @ x.T, y, c[i], eps[i])
        assert np.allclose(x @ (x.T @ beta[:, i]) + b[i], x @ (x.T @ one) + bias, atol=1e-5)


def test_histogram_boosting_sorts_no_rows(monkeypatch):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(600, 4)), 1)  # with ties
    task = Task(x, 5 * x[:, 0] - x[:, 2] ** 2 + rng.normal(size=600), "raw", Config(), 1)
    for t in (trees.Tree, trees.BinnedTree):
        at = rng.integers(0, 256, (300, 5)).astype(float)
        y, w = rng.normal(size=300), rng.integers(1, 4, 300).astype(float)
        nodes = [u(6, 5, max_leaves=12, ridge=0.1).fit(at, y, rng, w).nodes for u in (trees.Tree, t)]
        assert np.allclose(*[np.array(n) for n in nodes])
    with monkeypatch.context() as m:
        m.setattr(trees, "BinnedTree", trees.Tree)
        sorted_rows = trees.hist_boosting(task)(x)
    monkeypatch.setattr(np, "argsort", lambda *a, **k: pytest.fail("rows are sorted"))
    assert np.allclose(trees.hist_boosting(task)(x), sorted_rows)


@pytest.mark.parametrize("held", [0, 1 << 28])
@pytest.mark.parametrize("gamma", [1e-3, 0.05, 5.0])
def test_conjugate_gradients_equal_a_solver(gamma, held, monkeypatch):
    """Also with near and equal rows, whose kernel has eigenvalues about zero."""
    monkeypatch.setattr(base, "HELD", held)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(900, 8))
    x[300:340], x[500:800] = x[300], x[:300] + 1e-3 * rng.normal(size=(300, 8))
    y, shifts = rng.normal(size=(900, 3)), np.array([1e-3, 0.1, 10.0])
    k = np.exp(-gamma * squared_distances(x, x))
    gram = Gram(x, lambda d: np.exp(-gamma * d))
    assert (gram.matrix is None) == (not held) and np.allclose(gram @ y, k @ y, atol=1e-9)
    w = solve_shifted(gram, shifts, y)
    for i, a in enumerate(shifts):
        assert np.allclose(w[:, i], np.linalg.solve(k + a * np.eye(900), y[:, i]), atol=1e-6 / a)
    late = solve_shifted(gram, shifts, y, rounds=0)  # by factors
    assert np.allclose(k @ late, k @ w, atol=1e-6)


def _path(name, x, z, x2):
    if name == "KRR-RBF":
        return similarity.krr_path(x, z, x2, [(0.1, 0.01), (1.0, 0.01)])
    return similarity.lssvm_path(x, z, x2, [(1.0, 50.0), (10.0, 50.0)])


@pytest.mark.parametrize("name", ["KRR-RBF", "RBF-LS-SVM"])
def test_large_kernels_are_not_held(name, monkeypatch):
    """Above HELD bytes no matrix of all rows is there, and predictions are those of a factor."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2800, 6))
    z = x[:, 0] + 0.1 * rng.normal(size=2800)
    with monkeypatch.context() as m:
        m.setattr(similarity, "DIRECT", 10_000, raising=False)
        by_factor = _path(name, x, z, x[:50])
    monkeypatch.setattr(base, "HELD", 0, raising=False)
    tracemalloc.start()
    got = _path(name, x, z, x[:50])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 0.8 * 8 * 2800**2 and np.allclose(got, by_factor, atol=1e-7)


def test_large_kernels_of_scores_are_not_held(monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2800, 6))
    task = Task(x, x[:, 0] + 0.1 * rng.normal(size=2800), "raw", replace(Config(), level="fast", inner_repeats=1), 1)
    monkeypatch.setattr(similarity, "_lssvm_options", lambda task: [(10.0, 50.0)])
    monkeypatch.setattr(base, "HELD", 0, raising=False)
    tracemalloc.start()
    got = similarity.pls_lssvm(task)(x[:50])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 0.8 * 8 * 2800**2
    monkeypatch.setattr(similarity, "DIRECT", 10_000, raising=False)
    assert np.allclose(got, similarity.pls_lssvm(task)(x[:50]), atol=1e-7)


@pytest.mark.parametrize("name", ["GPR-Matern32", "GPR-SE"])
def test_gaussian_process_search(name, monkeypatch):
    """Two settings are sought, with fewer factors than three took, and none near them is likelier."""
    rng = np.random.default_rng(10)
    x = rng.normal(size=(90, 3))
    y = np.sin(x[:, 0]) + x[:, 1] + 0.2 * rng.normal(size=90)
    seen, real = [], similarity.cholesky
    monkeypatch.setattr(similarity, "cholesky", lambda m, *a: seen.append(m.copy()) or real(m, *a))
    registry.fit(name, Task(x, y, "raw", Config(), 1))
    assert len(seen) < 240
    k, s = np.tril(seen[-1]), base.Standard(x)  # the last factor is that of the settings chosen
    k = k + np.tril(k, -1).T
    z, pc = (y - y.mean()) / y.std(), base.Components(s(x), 3)
    c = z @ np.linalg.solve(k, z) / 90
    loss = lambda m: 0.5 * (z @ np.linalg.solve(m, z) + np.linalg.slogdet(m)[1])
    d = np.sqrt(squared_distances(pc(s(x)), pc(s(x))))
    ratio, matern = k[0, 0] - 1, name != "GPR-SE"
    i, j = np.unravel_index(np.argmax(d), d.shape)
    grid = np.exp(np.linspace(-4, 5, 4000))
    length = grid[np.argmin(np.abs(similarity.covariance(d[i, j], grid, matern) - k[i, j]))]
    for up in (0.8, 1.25):
        for other in (c * similarity.covariance(d, length * up, matern) + c * ratio * np.eye(90), c * similarity.covariance(d, length, matern) + c * ratio * up * np.eye(90), up * c * k):
            assert loss(other) > loss(c * k)


def test_svr_of_many_rows(monkeypatch):
    """Neither vectors of the kernel nor a matrix of all rows; the optimality conditions hold."""
    rng = np.random.default_rng(11)
    n = 2400
    x = rng.normal(size=(n, 6))
    y = x[:, 0] - 0.5 * x[:, 1] + 0.3 * rng.normal(size=n)
    config = replace(Config(), level="fast", inner_repeats=1)
    monkeypatch.setattr(base, "HELD", 0, raising=False)
    monkeypatch.setattr(similarity, "tuned", lambda *a: 0)
    real = np.linalg.eigh
    monkeypatch.setattr(np.linalg, "eigh", lambda a: real(a) if len(a) < n else pytest.fail("a whole kernel is decomposed"))
    tracemalloc.start()
    p = similarity.svr_rbf(Task(x, y, "raw", config, 1))(x[:100])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 0.8 * 8 * n**2 and np.corrcoef(p, y[:100])[0, 1] > 0.9
    monkeypatch.setattr(base, "HELD", 1 << 28)
    x, y = x[:600], y[:600]
    c, eps, y = np.array([0.3, 30.0]), np.array([0.1, 0.03]), (y - y.mean()) / y.std()
    k = np.exp(-0.1 * squared_distances(x, x))
    beta, b = similarity.svr_products(Gram(x, lambda d: np.exp(-0.1 * d)), y, c, eps)
    r = y[:, None] - k @ beta - b
    for i in range(2):
        size = np.abs(beta[:, i])
        free, tol = (size > 1e-6 * c[i]) & (size < c[i] * (1 - 1e-6)), 5e-3
        assert size.max() <= c[i] and abs(beta[:, i].sum()) < 1e-2 * max(1, size.max())
        assert (np.abs(r[size <= 1e-6 * c[i], i]) <= eps[i] + tol).all()
        assert (np.abs(r[free, i] - eps[i] * np.sign(beta[free, i])) <= tol).all()
        at = size >= c[i] * (1 - 1e-6)
        assert (r[at, i] * np.sign(beta[at, i]) >= eps[i] - tol).all()


def test_super_stack_decomposes_no_kernel(monkeypatch):
    """Neither the folds' nor the last models' kernels; only parts of them are."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(1400, 5))
    y = x[:, 0] - x[:, 1] + 0.2 * rng.normal(size=1400)
    monkeypatch.setattr(registry, "SUPER", ("PLS", "KRR-RBF", "SVR-RBF", "RBF-LS-SVM"))
    monkeypatch.setattr(registry, "SUPER_IF_THERE", ())
    monkeypatch.setattr(similarity, "tuned", lambda *a: 3)
    monkeypatch.setattr(similarity, "pooled", lambda *a: 6)
    largest, eigh, solve = [0], np.linalg.eigh, np.linalg.cholesky
    monkeypatch.setattr(np.linalg, "eigh", lambda a: largest.append(len(a)) or eigh(a))
    monkeypatch.setattr(np.linalg, "cholesky", lambda a: largest.append(len(a)) or solve(a))
    p = registry.fit("SuperStacking", Task(x, y, "raw", replace(Config(), level="fast", inner_repeats=1), 1))(x)
    assert np.corrcoef(p, y)[0, 1] > 0.95 and max(largest) < 1400 / 4

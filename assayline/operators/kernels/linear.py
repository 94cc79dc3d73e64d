"""Latent-variable and linear kernels."""

from __future__ import annotations

import numpy as np

from assayline.operators.kernels.base import Components, Predictor, Standard, Task, tuned


def pls_path(x: np.ndarray, y: np.ndarray, most: int) -> tuple[np.ndarray, Standard, float, float]:
    """Coefficients on standardised x (ddof 1) of PLS1 with 1 to `most` components, the scaling, and y's mean and deviation."""
    scale = Standard(x, 1)
    e = scale(x)
    mean, sd = float(y.mean()), float(y.std(ddof=1)) if len(y) > 1 else 1.0
    sd = sd if sd > 1e-12 else 1.0
    f = (y - mean) / sd
    ws, ps, qs, betas = [], [], [], []
    for _ in range(max(1, min(most, x.shape[1], len(y) - 1))):
        w = e.T @ f
        size = np.linalg.norm(w)
        if size < 1e-12:
            break
        w = w / size
        t = e @ w
        tt = float(t @ t)
        if tt < 1e-14:
            break
        p, q = e.T @ t / tt, float(f @ t / tt)
        e, f = e - np.outer(t, p), f - q * t
        ws.append(w)
        ps.append(p)
        qs.append(q)
        w_, p_ = np.array(ws).T, np.array(ps).T
        betas.append(w_ @ np.linalg.lstsq(p_.T @ w_, np.array(qs), rcond=None)[0] * sd)
    if not betas:
        betas.append(np.zeros(x.shape[1]))
    return np.array(betas), scale, mean, sd


def _pls_predictions(x, z, x2, most):
    b, scale, mean, _ = pls_path(x, z, most)
    p = b @ scale(x2).T + mean
    return np.vstack([p, np.repeat(p[-1:], most - len(p), axis=0)]) if len(p) < most else p


def pls_scores(x: np.ndarray, y: np.ndarray, k: int):
    """A map from rows to their k PLS scores."""
    scale = Standard(x, 1)
    e = scale(x)
    f = (y - y.mean()) / (y.std(ddof=1) if y.std(ddof=1) > 1e-12 else 1.0)
    ws, ps = [], []
    for _ in range(max(1, min(k, x.shape[1], len(y) - 1))):
        w = e.T @ f
        size = np.linalg.norm(w)
        if size < 1e-12:
            break
        w = w / size
        t = e @ w
        tt = float(t @ t)
        if tt < 1e-14:
            break
        p = e.T @ t / tt
        e, f = e - np.outer(t, p), f - (f @ t / tt) * t
        ws.append(w)
        ps.append(p)
    if not ws:
        return lambda a: np.zeros((len(a), 1))
    w, p = np.array(ws).T, np.array(ps).T
    rotate = w @ np.linalg.pinv(p.T @ w)
    return lambda a: scale(a) @ rotate


def most_components(task: Task, cap: int) -> int:
    """Components that the smallest fold can bear."""
    smallest = len(task.y) - -(-len(task.y) // task.config.inner_folds)
    return max(1, min(cap, task.x.shape[1], smallest - 1))


def tuned_components(task: Task, k: int | None = None, repeats: int | None = None) -> int:
    most = most_components(task, task.config.max_pls_components)
    return 1 + tuned(task, lambda x, z, x2: _pls_predictions(x, z, x2, most), range(1, most + 1), repeats, k)


def pls(task: Task) -> Predictor:
    k = tuned_components(task)
    b, scale, mean, _ = pls_path(task.x, task.z, k)
    return lambda a: scale(a) @ b[min(k, len(b)) - 1] + mean


def ridge_path(x: np.ndarray, z: np.ndarray, x2: np.ndarray, alphas: np.ndarray) -> np.ndarray:
    """Predictions for x2 of ridge regressions with an intercept, one for each penalty, from one decomposition."""
    mean, mx = z.mean(), x.mean(0)
    u, s, vt = np.linalg.svd(x - mx, full_matrices=False)
    shrunk = s / (s * s + np.asarray(alphas)[:, None]) * (u.T @ (z - mean))
    return shrunk @ vt @ (x2 - mx).T + mean


def ridge(task: Task) -> Predictor:
    alphas = np.logspace(-2, 6, 17)

    def path(x, z, x2):
        s = Standard(x)
        return ridge_path(s(x), z, s(x2), alphas)

    i = tuned(task, path, 1 / alphas)
    s, z = Standard(task.x), task.z
    return lambda a: ridge_path(s(task.x), z, s(a), alphas[i : i + 1])[0]


def pcr_path(x: np.ndarray, z: np.ndarray, x2: np.ndarray, ks: list[int]) -> np.ndarray:
    """Predictions of ridge regressions with penalty 1 on the first k component scores of scaled x, for each k."""
    s = Standard(x)
    pc = Components(s(x), max(ks))
    t, t2 = pc(s(x)), pc(s(x2))
    return np.array([ridge_path(t[:, :k], z, t2[:, :k], np.ones(1))[0] for k in ks])


def pcr(task: Task) -> Predictor:
    most = most_components(task, task.config.max_pcr_components)
    ks = list(range(1, most + 1))
    k = 1 + tuned(task, lambda x, z, x2: pcr_path(x, z, x2, ks), ks)
    return lambda a: pcr_path(task.x, task.z, a, [k])[0]


def elastic_path(x: np.ndarray, z: np.ndarray, alphas: np.ndarray, shares: np.ndarray, rounds: int = 1000, tol: float = 1e-5) -> tuple[np.ndarray, float]:
    """Coefficients (one column for each penalty) and intercept of 1/2n |z - xw|^2 + a s |w|_1 + a (1 - s) / 2 |w|^2 on centred x.

    Accelerated proximal gradient on the Gram matrix, all penalties at once,
    with a restart whenever momentum points uphill.
    """
    n = len(z)
    mean = z.mean()
    g, c = x.T @ x / n, x.T @ (z - mean) / n
    l1, l2 = alphas * shares, alphas * (1 - shares)
    step = 1 / (np.linalg.eigvalsh(g)[-1] + l2 + 1e-12)
    w = np.zeros((x.shape[1], len(alphas)))
    v, t = w.copy(), 1.0
    for _ in range(rounds):
        grad = g @ v - c[:, None] + l2 * v
        u = v - step * grad
        new = np.sign(u) * np.maximum(np.abs(u) - step * l1, 0)
        if ((v - new) * (new - w)).sum() > 0:
            v, t = w.copy(), 1.0
            continue
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t2 * (new - w)
        moved = np.abs(new - w).max()
        w, t = new, t2
        if moved < tol * max(1.0, np.abs(w).max()):
            break
    return w, float(mean)


def _elastic(task: Task, alphas: np.ndarray, shares: np.ndarray, complexity: np.ndarray) -> Predictor:
    def path(x, z, x2):
        s = Standard(x)
        w, mean = elastic_path(s(x), z, alphas, shares)
        return (s(x2) @ w).T + mean

    i = tuned(task, path, complexity)
    s = Standard(task.x)
    w, mean = elastic_path(s(task.x), task.z, alphas[i : i + 1], shares[i : i + 1])
    return lambda a: s(a) @ w[:, 0] + mean


def lasso(task: Task) -> Predictor:
    alphas = np.logspace(-3, 2, 36)
    return _elastic(task, alphas, np.ones(36), 1 / alphas)


def elastic_net(task: Task) -> Predictor:
    shares, alphas = (a.ravel() for a in np.meshgrid([0.1, 0.25, 0.5, 0.75, 0.9], np.logspace(-3, 2, 36), indexing="ij"))
    return _elastic(task, alphas, shares, 1 / alphas + 0.01 * (1 - shares))


def bayesian_ridge(task: Task, rounds: int = 300, tol: float = 1e-3) -> Predictor:
    """Evidence maximisation with gamma priors of 1e-6."""
    s, z = Standard(task.x), task.z
    x, mean = s(task.x), z.mean()
    y = z - mean
    n, hyper = len(y), 1e-6
    u, d, vt = np.linalg.svd(x, full_matrices=False)
    uy, noise, weight, old = u.T @ y, 1 / (y.var() + 1e-12), 1.0, None
    for _ in range(rounds):
        w = vt.T @ (d / (d * d + weight / noise) * uy)
        gamma = float((noise * d * d / (weight + noise * d * d)).sum())
        weight = (gamma + 2 * hyper) / (float(w @ w) + 2 * hyper)
        noise = (n - gamma + 2 * hyper) / (float(((y - x @ w) ** 2).sum()) + 2 * hyper)
        if old is not None and np.abs(w - old).sum() < tol:
            break
        old = w
    w = vt.T @ (d / (d * d + weight / noise) * uy)
    return lambda a: s(a) @ w + mean


def huber(task: Task, epsilon: float = 1.35, alpha: float = 0.1, rounds: int = 500) -> Predictor:
    """Concomitant-scale Huber regression: weights and scale in turn until both rest."""
    s, z = Standard(task.x), task.z
    x = np.column_stack([s(task.x), np.ones(len(z))])
    penalty = np.diag(np.r_[np.full(x.shape[1] - 1, alpha), 0.0])
    w, sigma = np.zeros(x.shape[1]), max(float(np.std(z)), 1e-6)
    w[-1] = np.median(z)
    for _ in range(rounds):
        r = z - x @ w
        out = np.abs(r) > epsilon * sigma
        v = np.where(out, epsilon * sigma / np.maximum(np.abs(r), 1e-12), 1.0) / sigma
        new = np.linalg.solve((x * v[:, None]).T @ x + penalty + 1e-10 * np.eye(x.shape[1]), x.T @ (v * z))
        r = z - x @ new
        out = np.abs(r) > epsilon * sigma
        room = len(z) - epsilon**2 * out.sum()
        scale = np.sqrt(float((r[~out] ** 2).sum()) / room) if room > 0 else sigma
        moved = np.abs(new - w).max() + abs(scale - sigma)
        w, sigma = new, max(scale, 1e-6)
        if moved < 1e-8:
            break
    return lambda a: s(a) @ w[:-1] + w[-1]

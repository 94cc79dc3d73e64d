"""Tree ensembles and a small perceptron."""

from __future__ import annotations

import heapq

import numpy as np

from assayline.operators.kernels.base import Predictor, Scale, Standard, Task


class Tree:
    """A regression tree of least weighted squared error.

    best_first grows the leaf of greatest gain up to max_leaves, else all leaves
    up to the depth. random draws one threshold for each feature. ridge is added
    to a leaf's weight in its value.
    """

    def __init__(self, depth: int, leaf: int, features: int | None = None, random: bool = False, max_leaves: int | None = None, ridge: float = 0.0):
        self.depth, self.leaf, self.features, self.random, self.max_leaves, self.ridge = depth, leaf, features, random, max_leaves, ridge

    def _value(self, y, w):
        return float((w * y).sum() / (w.sum() + self.ridge)) if len(y) else 0.0

    def _split(self, x, y, w, rng):
        n, p = x.shape
        if n < 2 * self.leaf:
            return None
        cols = rng.choice(p, self.features, replace=False) if self.features and self.features < p else np.arange(p)
        xs = x[:, cols]
        if self.random:
            lo, hi = xs.min(0), xs.max(0)
            cut = lo + rng.random(len(cols)) * (hi - lo)
            left = xs <= cut
            count = left.sum(0)
            wl, sl = w @ left, (w * y) @ left
            ok = (count >= self.leaf) & (n - count >= self.leaf) & (hi > lo)
            gain = np.where(ok, sl**2 / np.maximum(wl + self.ridge, 1e-12) + ((w * y).sum() - sl) ** 2 / np.maximum(w.sum() - wl + self.ridge, 1e-12), -np.inf)
            j = int(np.argmax(gain))
            best, threshold = gain[j], cut[j]
        else:
            order = np.argsort(xs, axis=0, kind="stable")
            v = np.take_along_axis(xs, order, 0)
            wl, sl = np.cumsum(w[order], 0)[:-1], np.cumsum((w * y)[order], 0)[:-1]
            count = np.arange(1, n)[:, None]
            ok = (v[1:] > v[:-1]) & (count >= self.leaf) & (n - count >= self.leaf)
            gain = np.where(ok, sl**2 / np.maximum(wl + self.ridge, 1e-12) + ((w * y).sum() - sl) ** 2 / np.maximum(w.sum() - wl + self.ridge, 1e-12), -np.inf)
            i, j = np.unravel_index(np.argmax(gain), gain.shape)
            best, threshold = gain[i, j], (v[i, j] + v[i + 1, j]) / 2
        gain = best - (w * y).sum() ** 2 / max(w.sum() + self.ridge, 1e-12)
        return (gain, int(cols[j]), float(threshold)) if np.isfinite(best) and gain > 1e-12 else None

    def fit(self, x: np.ndarray, y: np.ndarray, rng, w: np.ndarray | None = None) -> Tree:
        w = np.ones(len(y)) if w is None else w
        self.nodes = [[-1, 0.0, -1, -1, self._value(y, w)]]
        heap, tick = [], 0

        def offer(node, rows, depth):
            nonlocal tick
            if depth < self.depth and (s := self._split(x[rows], y[rows], w[rows], rng)):
                tick += 1
                heapq.heappush(heap, (-s[0] if self.max_leaves else tick, tick, node, rows, depth, s))

        offer(0, np.arange(len(y)), 0)
        leaves = 1
        while heap and (self.max_leaves is None or leaves < self.max_leaves):
            *_, node, rows, depth, (_, j, t) = heapq.heappop(heap)
            left = x[rows, j] <= t
            ids = []
            for part in (rows[left], rows[~left]):
                self.nodes.append([-1, 0.0, -1, -1, self._value(y[part], w[part])])
                ids.append(len(self.nodes) - 1)
                offer(ids[-1], part, depth + 1)
            self.nodes[node][:4] = [j, t, *ids]
            leaves += 1
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, cut, left, right, value = (np.array(c) for c in zip(*self.nodes, strict=True))
        at = np.zeros(len(x), int)
        while (inner := feature[at] >= 0).any():
            i = np.flatnonzero(inner)
            n = at[i]
            at[i] = np.where(x[i, feature[n]] <= cut[n], left[n], right[n])
        return value[at]


class BinnedTree(Tree):
    """A tree over columns of whole numbers from 0 to 255: splits are sought in histograms, so a node costs its rows, without sorting."""

    def _split(self, x, y, w, rng):
        n, p = x.shape
        if n < 2 * self.leaf:
            return None
        at = (x.astype(np.int64) + np.arange(p) * 256).ravel()

        def histogram(v=None):
            return np.bincount(at, None if v is None else np.repeat(v, p), 256 * p).reshape(p, 256)

        rows = histogram()
        ones = bool((w == 1).all())
        count = np.cumsum(rows, 1)
        wl, sl = count.astype(float) if ones else np.cumsum(histogram(w), 1), np.cumsum(histogram(y if ones else w * y), 1)
        ok = (rows > 0) & (count >= self.leaf) & (n - count >= self.leaf)
        gain = np.where(ok, sl**2 / np.maximum(wl + self.ridge, 1e-12) + ((w * y).sum() - sl) ** 2 / np.maximum(w.sum() - wl + self.ridge, 1e-12), -np.inf)
        best = gain.max()
        if not np.isfinite(best):
            return None
        j, i = np.nonzero(gain == best)
        k = np.lexsort((j, count[j, i]))[0]  # of equals the fewest rows on the left, then the first column
        j, i = int(j[k]), int(i[k])
        after = i + 1 + int(np.flatnonzero(rows[j, i + 1 :])[0])
        gain = best - (w * y).sum() ** 2 / max(w.sum() + self.ridge, 1e-12)
        return (gain, j, (i + after) / 2) if gain > 1e-12 else None


def _forest(task: Task, n: int, bootstrap: bool, **tree) -> Predictor:
    rng, z = np.random.default_rng(task.seed), task.z
    features = max(1, int(np.sqrt(task.x.shape[1])))
    trees = []
    for _ in range(n):
        rows = rng.integers(0, len(z), len(z)) if bootstrap else np.arange(len(z))
        trees.append(Tree(features=features, **tree).fit(task.x[rows], z[rows], rng))
    return lambda a: np.mean([t.predict(a) for t in trees], axis=0)


def random_forest(task: Task) -> Predictor:
    return _forest(task, 500, True, depth=6, leaf=3)


def extra_trees(task: Task) -> Predictor:
    return _forest(task, 500, False, depth=7, leaf=3, random=True)


def _boosted(task: Task, n: int, rate: float, sample: float, make) -> Predictor:
    rng, z = np.random.default_rng(task.seed), task.z
    base, at, trees = float(z.mean()), np.full(len(z), z.mean()), []
    for _ in range(n):
        rows = rng.choice(len(z), max(1, int(sample * len(z))), replace=False) if sample < 1 else np.arange(len(z))
        t = make().fit(task.x[rows], (z - at)[rows], rng)
        if len(t.nodes) == 1 and sample == 1:
            break  # nothing left to split on: later rounds are the same
        at += rate * t.predict(task.x)
        trees.append(t)
    return lambda a: base + rate * np.sum([t.predict(a) for t in trees], axis=0) if trees else np.full(len(a), base)


def gradient_boosting(task: Task) -> Predictor:
    return _boosted(task, 250, 0.03, 0.85, lambda: Tree(2, 4))


def hist_boosting(task: Task) -> Predictor:
    """Leaf-wise boosting on at most 255 bins with ridge leaf values."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, 256)[1:-1])) for c in task.x.T]

    def binned(a):
        return np.column_stack([np.searchsorted(e, c) for e, c in zip(edges, a.T, strict=True)]).astype(float)

    from dataclasses import replace

    f = _boosted(replace(task, x=binned(task.x)), 350, 0.04, 1.0, lambda: BinnedTree(10**6, 20, max_leaves=31, ridge=0.1))
    return lambda a: f(binned(a))


def ada_boost(task: Task, n: int = 200, rate: float = 0.05) -> Predictor:
    """AdaBoost.R2 with linear loss: resampling by weight, weighted median of the trees."""
    rng, z = np.random.default_rng(task.seed), task.z
    w, trees, votes = np.full(len(z), 1 / len(z)), [], []
    for _ in range(n):
        rows = rng.choice(len(z), len(z), p=w)
        t = Tree(3, 2).fit(task.x[rows], z[rows], rng)
        err = np.abs(t.predict(task.x) - z)
        if err.max() <= 0:
            trees, votes = [*trees, t], [*votes, 1.0]
            break
        loss = err / err.max()
        mean = float((w * loss).sum())
        if mean >= 0.5:
            if not trees:
                trees, votes = [t], [1.0]
            break
        beta = mean / (1 - mean)
        trees.append(t)
        votes.append(rate * np.log(1 / beta))
        w = w * beta ** ((1 - loss) * rate)
        w /= w.sum()

    def predict(a):
        p = np.array([t.predict(a) for t in trees])
        order = np.argsort(p, axis=0)
        total = np.cumsum(np.array(votes)[order], axis=0)
        at = (total >= 0.5 * total[-1]).argmax(0)
        return p[order[at, np.arange(p.shape[1])], np.arange(p.shape[1])]

    return predict


def perceptron(task: Task, hidden=(32, 16), penalty: float = 0.01, rate: float = 5e-4, epochs: int = 1500, patience: int = 30, held: float = 0.2) -> Predictor:
    """ReLU layers by Adam, stopped when the held-out rows gain nothing for `patience` epochs; the best weights stay."""
    rng = np.random.default_rng(task.seed)
    s, own = Standard(task.x), Scale.fit("standard", task.z)
    x, y = s(task.x), own.forward(task.z)
    order = rng.permutation(len(y))
    cut = max(1, int(round(held * len(y))))
    te, tr = order[:cut], order[cut:]
    sizes = [x.shape[1], *hidden, 1]
    params = [p for a, b in zip(sizes, sizes[1:], strict=False) for p in (rng.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b)), np.zeros(b))]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def forward(a, ps):
        acts = [a]
        for i in range(0, len(ps), 2):
            a = a @ ps[i] + ps[i + 1]
            a = np.maximum(a, 0) if i < len(ps) - 2 else a
            acts.append(a)
        return acts

    best, kept, idle, step = np.inf, params, 0, 0
    batch = min(200, len(tr))
    for _ in range(epochs):
        mixed = rng.permutation(tr)
        for at in range(0, len(mixed), batch):
            rows = mixed[at : at + batch]
            acts = forward(x[rows], params)
            g = (acts[-1][:, 0] - y[rows])[:, None] / len(rows)
            grads = [None] * len(params)
            for i in range(len(params) - 2, -1, -2):
                a = acts[i // 2]
                grads[i], grads[i + 1] = a.T @ g + penalty * params[i] / len(rows), g.sum(0)
                g = (g @ params[i].T) * (a > 0)
            step += 1
            for i, grad in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad * grad
                params[i] = params[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        loss = float(np.mean((forward(x[te], params)[-1][:, 0] - y[te]) ** 2))
        idle = 0 if loss < best - 1e-4 else idle + 1
        if loss < best:
            best, kept = loss, [p.copy() for p in params]
        if idle >= patience:
            break
    return lambda a: own.inverse(forward(s(a), kept)[-1][:, 0])

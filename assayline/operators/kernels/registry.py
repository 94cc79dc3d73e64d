"""Kernels by name, optional libraries and stacking."""

from __future__ import annotations

import importlib.util
from dataclasses import replace

import numpy as np

from assayline.operators.kernels import linear, similarity, trees
from assayline.operators.kernels.base import Predictor, Scale, Task
from assayline.operators.splits import folds

KERNELS = {
    "PLS": linear.pls, "PCR": linear.pcr, "Ridge": linear.ridge, "LASSO": linear.lasso, "ElasticNet": linear.elastic_net, "BayesianRidge": linear.bayesian_ridge, "Huber": linear.huber,
    "SVR-RBF": similarity.svr_rbf, "SVR-Linear": similarity.svr_linear, "KRR-RBF": similarity.krr, "RBF-LS-SVM": similarity.lssvm, "PLS-LSSVM": similarity.pls_lssvm,
    "GPR-SE": similarity.gpr_se, "GPR-Matern32": similarity.gpr_matern32, "KNN": similarity.knn, "ELM": similarity.elm,
    "RandomForest": trees.random_forest, "ExtraTrees": trees.extra_trees, "GradientBoosting": trees.gradient_boosting, "HistGBR": trees.hist_boosting, "AdaBoost": trees.ada_boost, "ANN-MLP": trees.perceptron,
}
#: Algorithms of libraries that may be missing; a missing one is an error row, never another algorithm.
OPTIONAL = {"XGBoost": "xgboost", "LightGBM": "lightgbm", "CatBoost": "catboost", "TorchMLP": "torch", "Torch1DCNN": "torch", "TorchCNNGRU": "torch"}
#: The members of the stacks.
WEIGHTED = ("PLS", "RBF-LS-SVM", "KRR-RBF", "Ridge", "ExtraTrees")
STACKED = ("PLS", "RBF-LS-SVM", "SVR-RBF", "KRR-RBF", "Ridge", "ExtraTrees")
SUPER = ("PLS", "RBF-LS-SVM", "KRR-RBF", "SVR-RBF", "Ridge", "PCR", "ELM", "ExtraTrees")
#: Further members of the large stack where their libraries are there.
SUPER_IF_THERE = ("XGBoost", "LightGBM")
#: Algorithms that read neighbouring channels and so get the contiguous window.
CONTIGUOUS = ("Torch1DCNN", "TorchCNNGRU")


def available(name: str) -> bool:
    return name not in OPTIONAL or importlib.util.find_spec(OPTIONAL[name]) is not None


def out_of_fold(task: Task, names: tuple[str, ...], k: int = 5) -> np.ndarray:
    """Working-scale predictions for each calibration row by models that haven't seen it, one column for each name.

    task.nested(train, test), if given, rebuilds both matrices from raw rows, so
    that pretreatment and selection learn from the fold alone; responses are
    transformed with the fold's own state and brought to the outer scale.
    """
    outer = Scale.fit(task.transform, task.y)
    out = np.full((len(task.y), len(names)), np.nan)
    for i, (tr, te) in enumerate(folds(len(task.y), k, 1, task.seed)):
        x, x2 = task.nested(tr, te) if task.nested else (task.x[tr], task.x[te])
        inner = replace(task, x=x, y=task.y[tr], nested=None, seed=task.seed + 1009 * (i + 1))
        scale = Scale.fit(task.transform, task.y[tr])
        for j, name in enumerate(names):
            out[te, j] = outer.forward(scale.inverse(fit(name, inner)(x2)))
    if not np.isfinite(out).all():
        raise ValueError("a stack member has no finite prediction")
    return out


def weighted_stack(task: Task) -> Predictor:
    """Members weighted by inverse squared out-of-fold error."""
    oof, z = out_of_fold(task, WEIGHTED), task.z
    errors = np.maximum(np.sqrt(((oof - z[:, None]) ** 2).mean(0)), 1e-12)
    w = errors**-2.0
    w /= w.sum()
    models = [fit(n, task) for n in WEIGHTED]
    return lambda a: np.column_stack([m(a) for m in models]) @ w


def stack(task: Task) -> Predictor:
    """Ridge with penalty 1 over the members' predictions."""
    oof, z = out_of_fold(task, STACKED), task.z
    models = [fit(n, task) for n in STACKED]
    return lambda a: linear.ridge_path(oof, z, np.column_stack([m(a) for m in models]), np.ones(1))[0]


def super_stack(task: Task) -> Predictor:
    """Ridge over the members' predictions, its penalty by leave-one-out error of the out-of-fold ones."""
    names = SUPER + tuple(n for n in SUPER_IF_THERE if available(n))
    oof, z = out_of_fold(task, names), task.z
    mean, centre = z.mean(), oof.mean(0)
    u, s, vt = np.linalg.svd(oof - centre, full_matrices=False)
    uz, best = u.T @ (z - mean), None
    for alpha in np.logspace(-2, 4, 15):
        shrink = s * s / (s * s + alpha)
        hat = (u * u) @ shrink + 1 / len(z)
        loo = (z - mean - u @ (shrink * uz)) / np.maximum(1 - hat, 1e-12)
        if best is None or (loo @ loo) < best[0]:
            best = (loo @ loo, vt.T @ (s / (s * s + alpha) * uz))
    models = [fit(n, task) for n in names]
    return lambda a: (np.column_stack([m(a) for m in models]) - centre) @ best[1] + mean


STACKS = {"WeightedStacking": weighted_stack, "SuperStacking": super_stack, "STACKING": stack}


def fit(name: str, task: Task) -> Predictor:
    if name in OPTIONAL:
        if not available(name):
            raise ModuleNotFoundError(f"{name} needs {OPTIONAL[name]}, which is not installed")
        from assayline.operators.kernels import optional

        return optional.fit(name, task)
    if name not in KERNELS and name not in STACKS:
        raise ValueError(f"unknown algorithm {name}")
    return (KERNELS | STACKS)[name](task)

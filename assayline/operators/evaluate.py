"""One configuration on one split: the body of the grouped map."""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable, Sequence

import numpy as np

from assayline.config import Config, stable_seed
from assayline.operators.kernels import registry
from assayline.operators.kernels.base import Scale, Task, choose, rmse
from assayline.operators.kernels.linear import pls_path
from assayline.operators.kernels.pretreat_np import pretreat
from assayline.operators.splits import folds


def usable(cal: np.ndarray) -> np.ndarray:
    """Channels that are finite and vary over the calibration rows."""
    with np.errstate(invalid="ignore"):
        return np.isfinite(cal).all(0) & (cal.std(0) > 1e-12)


def _flat_to_zero(s: np.ndarray) -> np.ndarray:
    s = np.where(np.isfinite(s), s, 0.0)
    span = s.max() - s.min() if len(s) else 0.0
    return (s - s.min()) / span if span >= 1e-12 else np.zeros_like(s)


def variable_scores(x: np.ndarray, z: np.ndarray, config: Config) -> np.ndarray:
    """0.70 of the scaled |PLS coefficient| on standardised channels and 0.30 of the scaled |correlation|."""
    b, *_ = pls_path(x, z, min(config.ranking_components, x.shape[1], len(z) - 2))
    d, e = x - x.mean(0), z - z.mean()
    size = np.linalg.norm(d, axis=0) * np.linalg.norm(e)
    corr = np.where((np.linalg.norm(d, axis=0) <= 1e-12) | (np.linalg.norm(e) <= 1e-12), 0.0, np.abs(d.T @ e) / np.maximum(size, 1e-300))
    return 0.70 * _flat_to_zero(np.abs(b[-1])) + 0.30 * _flat_to_zero(corr)


def select(scores: np.ndarray, count: int, contiguous: bool) -> np.ndarray:
    """Positions of the best `count` channels in order, the later among equals, or of the best neighbouring ones, the first among equals."""
    k = min(count, len(scores))
    if contiguous:
        total = np.convolve(scores, np.ones(k), "valid")
        first = int(np.argmax(np.round(total, 12)))
        return np.arange(first, first + k)
    return np.sort(np.lexsort((np.arange(len(scores)), scores))[::-1][:k])


def scored(recipe: str, cal: np.ndarray, other: np.ndarray, axis: np.ndarray, z: np.ndarray, config: Config) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pretreated and masked matrices, the channels' positions and their scores; nothing is learned from `other`."""
    a, b = pretreat(recipe, cal, other, axis)
    keep = np.flatnonzero(usable(a))
    if len(keep) < 2:
        raise ValueError("fewer than two usable channels")
    return a[:, keep], b[:, keep], keep, variable_scores(a[:, keep], z, config)


def _chosen(ready: tuple, count: int, contiguous: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, b, keep, scores = ready
    at = select(scores, count, contiguous)
    return a[:, at], b[:, at], keep[at]


def feature_count(raw: np.ndarray, y: np.ndarray, recipe: str, transform: str, axis: np.ndarray, config: Config, seed: int) -> int:
    """config.feature_count, or the number among several candidates that inner folds of the calibration rows choose.

    Candidates below feature_min are left out, those above the number of
    channels cut to it. In each fold a PLS model on the best channels predicts
    the rows left out, on the original scale; the fewest channels within one
    standard error of the best win.
    """
    options = sorted({min(k, raw.shape[1]) for k in config.feature_candidates if k >= min(config.feature_min, raw.shape[1])})
    if len(options) < 2:
        return options[0] if options else config.feature_count
    errors = []
    for tr, te in folds(len(y), config.inner_folds, config.inner_repeats, seed):
        scale = Scale.fit(transform, y[tr])
        z = scale.forward(y[tr])
        try:
            ready = scored(recipe, raw[tr], raw[te], axis, z, config)
        except (ValueError, np.linalg.LinAlgError):
            errors.append([np.inf] * len(options))
            continue
        row = []
        for k in options:
            x, x2, _ = _chosen(ready, k, False)
            b, own, mean, _ = pls_path(x, z, max(1, min(config.ranking_components, len(tr) - 2, x.shape[1])))
            row.append(rmse(y[te], scale.inverse(own(x2) @ b[-1] + mean)))
        errors.append(row)
    return options[choose(np.array(errors).T, options, config.one_standard_error)]


def screened(x: np.ndarray, y: np.ndarray, config: Config, seed: int) -> np.ndarray:
    """Which calibration rows a Monte-Carlo screen of their own keeps: all if it would leave under 12 or 85 % of them.

    A row goes if its mean held-out error is above median + 3 MAD, within the
    limits of the screen before a study. Failed fits are tried again; too many
    of them, or a row never held out, are an error.
    """
    n, every = len(y), np.ones(len(y), bool)
    if n < 15:
        return every
    rng, total, seen, done = np.random.default_rng(seed), np.zeros(n), np.zeros(n), 0
    for _ in range(max(5 * config.mccv_iterations, config.mccv_iterations + 20)):
        if done == config.mccv_iterations:
            break
        order = rng.permutation(n)
        cut = max(8, round(config.mccv_calibration * n))
        tr, te = order[:cut], order[cut:]
        k = min(config.max_pls_components, x.shape[1], len(tr) - 2)
        if len(te) < 3 or k < 1:
            continue
        b, scale, mean, _ = pls_path(x[tr], y[tr], k)
        error = np.abs(y[te] - scale(x[te]) @ b[-1] - mean)
        if np.isfinite(error).all():
            total[te] += error
            seen[te] += 1
            done += 1
    if done < config.mccv_iterations or not seen.all():
        raise RuntimeError(f"the calibration screen has {done} of {config.mccv_iterations} models, or rows never held out")
    mean_error = total / seen
    centre = np.median(mean_error)
    keep = mean_error <= centre + 3 * np.median(np.abs(mean_error - centre))
    if keep.sum() < 8 or (~keep).sum() > max(10, round(config.max_outlier_ratio * n)) or keep.sum() < max(12, round(0.85 * n)):
        return every
    return keep


def evaluate(raw: np.ndarray, y: np.ndarray, cal: np.ndarray, recipe: str, transform: str, algorithm: str, axis: np.ndarray, config: Config, seed_parts: tuple) -> dict:
    """Metrics, predictions and channels of one configuration; any failure is the text in `error`."""
    return evaluate_all(raw, y, cal, recipe, transform, [algorithm], axis, config, lambda _: seed_parts)[0]


def evaluate_all(raw: np.ndarray, y: np.ndarray, cal: np.ndarray, recipe: str, transform: str, algorithms: Sequence[str], axis: np.ndarray, config: Config, seed_parts: Callable[[str], tuple]) -> list[dict]:
    """`evaluate` of several algorithms; rows are pretreated and channels scored once for all of them."""
    early, failure, ready = [], None, None
    with warnings.catch_warnings(record=True) as early:
        warnings.simplefilter("always")
        try:
            ready = _ready(raw, y, cal, recipe, transform, axis, config)
        except Exception as e:  # a failed configuration is a row, not the end of a study
            failure = e
    out = []
    for algorithm in algorithms:
        began, got = time.perf_counter(), {"error": None}
        with warnings.catch_warnings(record=True) as caught:
            warnings.simplefilter("always")
            try:
                if failure is not None:
                    raise failure
                got |= _run(ready, raw, y, cal, recipe, transform, algorithm, axis, config, stable_seed(config.random_state, *seed_parts(algorithm)))
            except Exception as e:
                got["error"] = f"{type(e).__name__}: {e}"[:500]
        out.append(got | {"warnings": sorted({str(w.message)[:200] for w in [*early, *caught]}), "elapsed": time.perf_counter() - began})
    return out


def _ready(raw, y, cal, recipe, transform, axis, config) -> tuple:
    yc = y[cal]
    if transform in ("log1p", "sqrt") and yc.min() < 0:
        raise ValueError(f"{transform} needs responses of at least 0")
    count = feature_count(raw[cal], yc, recipe, transform, axis, config, stable_seed(config.random_state, "feature_count", recipe, transform))
    return scored(recipe, raw[cal], raw[~cal], axis, Scale.fit(transform, yc).forward(yc), config), count


def _run(ready, raw, y, cal, recipe, transform, algorithm, axis, config, seed) -> dict:
    yc, yp = y[cal], y[~cal]
    contiguous = algorithm in registry.CONTIGUOUS
    scale = Scale.fit(transform, yc)
    x, x2, chosen = _chosen(*ready, contiguous)
    rows = raw[cal]

    def nested(tr, te):
        z = Scale.fit(transform, yc[tr]).forward(yc[tr])
        count = feature_count(rows[tr], yc[tr], recipe, transform, axis, config, seed)
        return _chosen(scored(recipe, rows[tr], rows[te], axis, z, config), count, contiguous)[:2]

    predict = registry.fit(algorithm, Task(x, yc, transform, config, seed, nested if algorithm in registry.STACKS else None, axis))
    pc, pp = scale.inverse(np.asarray(predict(x), float)), scale.inverse(np.asarray(predict(x2), float))
    if len(pc) != len(yc) or len(pp) != len(yp) or not (np.isfinite(pc).all() and np.isfinite(pp).all()):
        raise ValueError("incomplete or non-finite predictions")
    r2 = lambda a, b: 1 - ((a - b) ** 2).sum() / ((a - a.mean()) ** 2).sum() if len(a) > 1 and a.std() >= 1e-12 else np.nan
    rmsec, rmsep = (float(np.sqrt(((a - b) ** 2).mean())) for a, b in ((yc, pc), (yp, pp)))
    out = {"Rc2": float(r2(yc, pc)), "Rp2": float(r2(yp, pp)), "RMSEC": rmsec, "RMSEP": rmsep, "MAE": float(np.abs(yp - pp).mean()), "RPD": float(yp.std() / max(rmsep, 1e-12))}
    if not np.isfinite(list(out.values())).all():
        raise ValueError("a metric isn't finite")
    predicted = np.empty(len(y))
    predicted[cal], predicted[~cal] = pc, pp
    return out | {"predicted": predicted, "channels": chosen}

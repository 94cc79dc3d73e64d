"""The pretreatment recipes on matrices, for rebuilding folds inside a kernel; state is learned from calibration rows only."""

from __future__ import annotations

import numpy as np

from assayline.config import RECIPES
from assayline.operators.pretreat import gradient_rows, polynomial_basis, smoothing_rows, smoothing_width


def operator(step: str, axis: np.ndarray) -> np.ndarray | None:
    """The channel-by-channel matrix of a linear row-wise step."""
    p = len(axis)
    if step in ("DETREND", "BASELINE_POLY2", "BASELINE_POLY3"):
        q = polynomial_basis(p, 1 if step == "DETREND" else int(step[-1]))
        return np.eye(p) - q.T @ q
    if step in ("SG", "SG1", "SG2"):
        order, width = int(step[2:] or 0), smoothing_width(p)
        if width < 5:
            return np.eye(p) if not order else operator(f"DE{order}", axis)
        rows, half, m = smoothing_rows(width, 2, order, float(np.median(np.abs(np.diff(axis)))) if order else 1.0), width // 2, np.zeros((p, p))
        for i in range(p):
            start = min(max(i - half, 0), p - width)
            m[i, start : start + width] = rows[i - start]
        return m
    if step in ("DE1", "DE2"):
        a, b, c = gradient_rows(axis, p)
        m = np.diag(b) + np.diag(a[1:], -1) + np.diag(c[:-1], 1)
        return m @ m if step == "DE2" else m
    return None


def pretreat(recipe: str, cal: np.ndarray, other: np.ndarray, axis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    def guard(s):
        return np.where(s < 1e-12, 1.0, s)

    for step in RECIPES[recipe]:
        if (m := operator(step, axis)) is not None:
            cal, other = cal @ m.T, other @ m.T
        elif step == "SNV":
            cal, other = ((a - a.mean(1, keepdims=True)) / guard(a.std(1, keepdims=True)) for a in (cal, other))
        elif step == "VECTOR_NORM":
            cal, other = (a / guard(np.linalg.norm(a, axis=1, keepdims=True)) for a in (cal, other))
        elif step == "AREA_NORM":
            cal, other = (a / guard(np.abs(a).sum(1, keepdims=True)) for a in (cal, other))
        elif step == "MSC":
            ref = cal.mean(0)
            d = ref - ref.mean()

            def corrected(a, ref=ref, d=d):
                k = ((a - a.mean(1, keepdims=True)) @ d / max(d @ d, 1e-300))[:, None]
                return np.where(np.abs(k) < 1e-12, a, (a - (a.mean(1, keepdims=True) - k * ref.mean())) / np.where(np.abs(k) < 1e-12, 1, k))

            cal, other = corrected(cal), corrected(other)
        else:
            lo, s = {
                "CENTER": lambda a: (a.mean(0), np.ones(a.shape[1])),
                "STANDARDIZE": lambda a: (a.mean(0), a.std(0)),
                "MINMAX": lambda a: (a.min(0), a.max(0) - a.min(0)),
                "ROBUST": lambda a: (np.median(a, 0), np.percentile(a, 75, axis=0) - np.percentile(a, 25, axis=0)),
            }[step](cal)
            cal, other = (cal - lo) / guard(s), (other - lo) / guard(s)
        cal, other = (np.where(np.isfinite(a), a, 0.0) for a in (cal, other))
    return cal, other

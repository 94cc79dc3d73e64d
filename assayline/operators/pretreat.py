"""Signal pretreatments over array columns; fitted state is learned from calibration rows only.

Input: one row for each signal with its split keys, a role ('cal' or 'pred') and x
array<double>. All steps are array expressions that stay in one stage; the
stateful ones add one aggregate over (split, channel) and a join of one state row
for each split.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.config import RECIPES
from assayline.functions.columns import EPS, cleaned, deviation, dot, guarded, let, mean, total, vector
from assayline.operators.quantiles import quantiles
from assayline.sources.shared import durable

STATEFUL = ("CENTER", "STANDARDIZE", "MINMAX", "ROBUST", "MSC")


def smoothing_rows(width: int, degree: int, derivative: int, spacing: float) -> np.ndarray:
    """Local polynomial fit over `width` equally spaced points: row i gives the derivative at point i."""
    at = np.arange(width) - (width - 1) / 2
    fit = np.linalg.pinv(np.vander(at, degree + 1, increasing=True))
    out = np.zeros((width, width))
    for i, t in enumerate(at):
        for k in range(derivative, degree + 1):
            factor = np.prod(np.arange(k - derivative + 1, k + 1)) if derivative else 1
            out[i] += factor * t ** (k - derivative) * fit[k]
    return out / spacing**derivative


def smoothing_width(channels: int, width: int = 17) -> int:
    """The odd window that fits; under 5 there is none."""
    return min(width, channels if channels % 2 else channels - 1)


def gradient_rows(axis: Sequence[float] | None, channels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of the previous, own and next channel of a second-order gradient; edges are one-sided.

    Without a usable axis (of another length, not finite or with repeated values) spacing is 1.
    """
    x = np.asarray(axis, float) if axis is not None else np.empty(0)
    if len(x) != channels or not np.isfinite(x).all() or (np.diff(x) == 0).any():
        x = np.arange(channels, dtype=float)
    h = np.diff(x)
    a, b, c = np.zeros(channels), np.zeros(channels), np.zeros(channels)
    hs, hd = h[:-1], h[1:]
    a[1:-1], b[1:-1], c[1:-1] = -hd / (hs * (hs + hd)), (hd - hs) / (hs * hd), hs / (hd * (hs + hd))
    b[0], c[0], a[-1], b[-1] = -1 / h[0], 1 / h[0], -1 / h[-1], 1 / h[-1]
    return a, b, c


def polynomial_basis(channels: int, degree: int) -> np.ndarray:
    """Orthonormal polynomials on [-1, 1], one for each row."""
    return np.linalg.qr(np.vander(np.linspace(-1, 1, channels), degree + 1, increasing=True))[0].T


def banded(x: Column, rows: np.ndarray, channels: int) -> Column:
    """Apply a symmetric-window filter: interior points its middle row, edge points the fit of the first or last window."""
    width = len(rows)
    half = width // 2
    table = F.array(*[vector(r) for r in rows])

    def at(i: Column, v: Column) -> Column:
        start = F.greatest(F.lit(0), F.least(i - half, F.lit(channels - width)))
        row = F.when(i < half, i).when(i >= channels - half, i - (channels - width)).otherwise(half)
        return dot(F.slice(v, start + 1, width), F.get(table, row))

    # x is bound first: earlier steps would be computed again for each channel
    return let(x, lambda v: F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda i: at(i, v)))


def _minus(out: Column, q: np.ndarray):
    return lambda c: F.zip_with(out, vector(q), lambda a, b: a - c * b)


def _without(x: Column, basis: np.ndarray) -> Column:
    """x without its projections on orthonormal rows."""
    out = x
    for q in basis:
        out = let(dot(x, vector(q)), _minus(out, q))
    return out


def _gradient(x: Column, axis, channels: int) -> Column:
    if channels < 2:
        return F.transform(x, lambda _: F.lit(0.0))
    a, b, c = gradient_rows(axis, channels)
    before = F.concat(vector([0.0]), F.slice(x, 1, channels - 1))
    after = F.concat(F.slice(x, 2, channels - 1), vector([0.0]))
    rows = F.arrays_zip(before.alias("p"), x.alias("o"), after.alias("n"), vector(a).alias("a"), vector(b).alias("b"), vector(c).alias("c"))
    return F.transform(rows, lambda r: r["p"] * r["a"] + r["o"] * r["b"] + r["n"] * r["c"])


def row_step(step: str, x: Column, axis: Sequence[float] | None, channels: int) -> Column:
    """A step that needs no state."""
    if step == "SNV":
        return let(mean(x), lambda m: let(guarded(deviation(x, m)), lambda s: F.transform(x, lambda v: (v - m) / s)))
    if step == "VECTOR_NORM":
        return let(guarded(F.sqrt(dot(x, x))), lambda n: F.transform(x, lambda v: v / n))
    if step == "AREA_NORM":
        return let(guarded(total(F.transform(x, lambda v: F.abs(v)))), lambda n: F.transform(x, lambda v: v / n))
    if step == "DETREND":
        return _without(x, polynomial_basis(channels, 1))
    if step in ("BASELINE_POLY2", "BASELINE_POLY3"):
        return _without(x, polynomial_basis(channels, int(step[-1])))
    if step in ("SG", "SG1", "SG2"):
        order = int(step[2:] or 0)
        width = smoothing_width(channels)
        if width < 5:
            return x if not order else row_step(f"DE{order}", x, axis, channels)
        spacing = float(np.median(np.abs(np.diff(np.asarray(axis, float))))) if order and axis is not None and len(axis) == channels else 1.0
        return banded(x, smoothing_rows(width, 2, order, spacing if np.isfinite(spacing) and spacing > 0 else 1.0), channels)
    if step == "DE1":
        return _gradient(x, axis, channels)
    if step == "DE2":
        return let(_gradient(x, axis, channels), lambda d: _gradient(d, axis, channels))
    raise ValueError(f"unknown pretreatment step {step}")


def fit_state(signals: DataFrame, keys: Sequence[str], step: str) -> DataFrame:
    """(keys, a, b): one row for each split with the step's state arrays, from its calibration rows.

    x' = (x - a) / b for CENTER (b is 1), STANDARDIZE, MINMAX and ROBUST; for MSC, a is the mean signal.
    """
    v = F.col("v")
    fits = {
        "CENTER": (F.avg(v), F.lit(1.0)),
        "STANDARDIZE": (F.avg(v), F.stddev_pop(v)),
        "MINMAX": (F.min(v), F.max(v) - F.min(v)),
        "MSC": (F.avg(v), F.lit(1.0)),
    }
    if step == "ROBUST":
        # exact quartiles read the signals several times
        long = durable(signals.where("role = 'cal'").select(*keys, "x")).select(*keys, F.posexplode("x").alias("pos", "v"))
        each = quantiles(long, [*keys, "pos"], v, {"q1": 0.25, "q2": 0.5, "q3": 0.75}).select(*keys, "pos", F.col("q2").alias("a"), guarded(F.col("q3") - F.col("q1")).alias("b"))
    else:
        a, b = fits[step]
        long = signals.where("role = 'cal'").select(*keys, F.posexplode("x").alias("pos", "v"))
        each = long.groupBy(*keys, "pos").agg(a.alias("a"), guarded(b).alias("b"))
    ordered = F.sort_array(F.collect_list(F.struct("pos", "a", "b")))
    return each.groupBy(*keys).agg(ordered.alias("s")).select(*keys, F.col("s.a").alias("a"), F.col("s.b").alias("b"))


def apply_state(x: Column, a: Column, b: Column, step: str) -> Column:
    if step != "MSC":
        shifted = F.zip_with(x, a, lambda v, m: v - m)
        return F.zip_with(shifted, b, lambda v, s: v / s)

    def line(mx: Column, ma: Column) -> Column:
        cross = F.aggregate(F.zip_with(x, a, lambda v, r: (v - mx) * (r - ma)), F.lit(0.0), lambda s, p: s + p)
        square = F.aggregate(a, F.lit(0.0), lambda s, r: s + (r - ma) * (r - ma))
        slope = F.when(square > 0, cross / square).otherwise(0.0)
        return let(slope, lambda k: F.when(F.abs(k) < EPS, x).otherwise(F.transform(x, lambda v: (v - (mx - k * ma)) / k)))

    return let(mean(x), lambda mx: let(mean(a), lambda ma: line(mx, ma)))


def pretreat(signals: DataFrame, recipe: str, axis: Sequence[float] | None, channels: int, keys: Sequence[str] = ()) -> DataFrame:
    """signals with x pretreated by the recipe's steps in order; keys name the split.

    Signals of another length than `channels`, or null, come out null. Every
    step's non-finite values become 0.
    """
    if recipe not in RECIPES:
        raise ValueError(f"unknown pretreatment {recipe}")
    out = signals.withColumn("x", F.when(F.size("x") == channels, F.col("x")))
    keys = list(keys)
    for step in RECIPES[recipe]:
        if step not in STATEFUL:
            out = out.withColumn("x", cleaned(row_step(step, F.col("x"), axis, channels)))
            continue
        # a split has one state row of two arrays, far below any table of signals
        state = fit_state(out.where("x is not null"), keys, step)
        out = out.join(state, keys, "left") if keys else out.crossJoin(F.broadcast(state))
        out = out.withColumn("x", cleaned(apply_state(F.col("x"), F.col("a"), F.col("b"), step))).drop("a", "b")
    return out

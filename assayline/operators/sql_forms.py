"""SQL forms of the pretreatments for a table t(sample_id, role, pos, v) of DuckDB: independent statements of what they compute."""

from __future__ import annotations

import numpy as np

from assayline.config import RECIPES
from assayline.operators.pretreat import gradient_rows, polynomial_basis, smoothing_rows, smoothing_width


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(repr(x) if isinstance(x, float) else str(x) for x in r) + ")" for r in rows)


def _clean(select: str) -> str:
    return f"SELECT sample_id, role, pos, CASE WHEN isfinite(v) THEN v ELSE 0.0 END AS v FROM ({select})"


def _operator(matrix: np.ndarray, src: str) -> str:
    rows = [(i, j, float(c)) for i, r in enumerate(matrix) for j, c in enumerate(r) if c]
    return f"SELECT t.sample_id, any_value(t.role) AS role, m.i AS pos, sum(t.v * m.c) AS v FROM {src} t JOIN (VALUES {_values(rows)}) AS m(i, j, c) ON t.pos = m.j GROUP BY t.sample_id, m.i"


def step_sql(step: str, src: str, axis: list[float]) -> str:
    p = len(axis)
    by_row = "OVER (PARTITION BY sample_id)"
    if step == "SNV":
        return f"SELECT sample_id, role, pos, (v - avg(v) {by_row}) / CASE WHEN stddev_pop(v) {by_row} < 1e-12 THEN 1 ELSE stddev_pop(v) {by_row} END AS v FROM {src}"
    if step == "VECTOR_NORM":
        return f"SELECT sample_id, role, pos, v / CASE WHEN sqrt(sum(v * v) {by_row}) < 1e-12 THEN 1 ELSE sqrt(sum(v * v) {by_row}) END AS v FROM {src}"
    if step == "AREA_NORM":
        return f"SELECT sample_id, role, pos, v / CASE WHEN sum(abs(v)) {by_row} < 1e-12 THEN 1 ELSE sum(abs(v)) {by_row} END AS v FROM {src}"
    if step == "DETREND":
        return f"SELECT sample_id, role, pos, v - (regr_intercept(v, pos) {by_row} + regr_slope(v, pos) {by_row} * pos) AS v FROM {src}"
    if step in ("BASELINE_POLY2", "BASELINE_POLY3"):
        q = polynomial_basis(p, int(step[-1]))
        return _operator(np.eye(p) - q.T @ q, src)
    if step in ("SG", "SG1", "SG2"):
        order, width = int(step[2:] or 0), smoothing_width(p)
        spacing = float(np.median(np.abs(np.diff(axis)))) if order else 1.0
        rows, half = smoothing_rows(width, 2, order, spacing), width // 2
        m = np.zeros((p, p))
        for i in range(p):
            start = min(max(i - half, 0), p - width)
            m[i, start : start + width] = rows[i - start]
        return _operator(m, src)
    if step in ("DE1", "DE2"):
        a, b, c = gradient_rows(axis, p)
        m = np.diag(b) + np.diag(a[1:], -1) + np.diag(c[:-1], 1)
        return _operator(m @ m if step == "DE2" else m, src)
    cal = f"(SELECT pos, {{}} FROM {src} WHERE role = 'cal' GROUP BY pos)"
    guard = "CASE WHEN s < 1e-12 THEN 1 ELSE s END"
    states = {
        "CENTER": "avg(v) AS m, 1.0 AS s",
        "STANDARDIZE": "avg(v) AS m, stddev_pop(v) AS s",
        "MINMAX": "min(v) AS m, max(v) - min(v) AS s",
        "ROBUST": "median(v) AS m, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS s",
    }
    if step in states:
        return f"SELECT sample_id, role, pos, (v - m) / ({guard}) AS v FROM {src} JOIN {cal.format(states[step])} USING (pos)"
    if step == "MSC":
        with_ref = f"(SELECT * FROM {src} JOIN {cal.format('avg(v) AS m')} USING (pos))"
        fit = f"(SELECT *, regr_slope(v, m) {by_row} AS k, regr_intercept(v, m) {by_row} AS o FROM {with_ref})"
        return f"SELECT sample_id, role, pos, CASE WHEN k IS NULL OR abs(k) < 1e-12 THEN v ELSE (v - o) / k END AS v FROM {fit}"
    raise ValueError(step)


def recipe_sql(recipe: str, source: str, axis: list[float], digits: int) -> str:
    """source: the CTE that makes t0."""
    ctes = [source]
    for i, step in enumerate(RECIPES[recipe]):
        ctes.append(f"t{i + 1} AS ({_clean(step_sql(step, f't{i}', axis))})")
    last = f"t{len(RECIPES[recipe])}"
    return f"WITH {', '.join(ctes)} SELECT sample_id, role, pos::BIGINT AS pos, round(v, {digits}) + 0.0 AS v FROM {last}"

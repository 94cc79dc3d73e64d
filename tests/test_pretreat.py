"""Every recipe against NumPy formulas; state comes from calibration rows only."""

import numpy as np
import pytest

from assayline.config import RECIPES
from assayline.operators.kernels.pretreat_np import pretreat as matrix_form
from assayline.operators.pretreat import gradient_rows, pretreat, smoothing_rows

P, N = 24, 12
AXIS = [200 + 2.5 * i + 0.02 * i * i for i in range(P)]


@pytest.fixture(scope="module")
def x():
    return np.random.default_rng(1).normal(5, 2, (N, P)) + np.linspace(0, 3, P)


def frame(spark, x, cal):
    return spark.createDataFrame([(i, "cal" if c else "pred", r.tolist()) for i, (r, c) in enumerate(zip(x, cal))], "sample_id int, role string, x array<double>")


CAL = np.arange(N) % 3 != 0


@pytest.mark.parametrize("recipe", RECIPES)
def test_recipe_equals_matrix_form(spark, x, recipe):
    got = {r.sample_id: r.x for r in pretreat(frame(spark, x, CAL), recipe, AXIS, P).collect()}
    a, b = matrix_form(recipe, x[CAL], x[~CAL], np.array(AXIS))
    want = np.empty_like(x)
    want[CAL], want[~CAL] = a, b
    np.testing.assert_allclose(np.array([got[i] for i in range(N)]), want, rtol=1e-8, atol=1e-8)


def test_gradient_is_numpy_gradient(x):
    a, b, c = gradient_rows(AXIS, P)
    m = np.diag(b) + np.diag(a[1:], -1) + np.diag(c[:-1], 1)
    np.testing.assert_allclose(m @ x[0], np.gradient(x[0], AXIS), atol=1e-12)


def test_smoothing_reproduces_polynomials():
    t = np.arange(17.0)
    y = 3 + 2 * t - 0.5 * t * t
    np.testing.assert_allclose(smoothing_rows(17, 2, 0, 1.0) @ y, y, atol=1e-9)
    np.testing.assert_allclose(smoothing_rows(17, 2, 1, 1.0) @ y, 2 - t, atol=1e-9)
    np.testing.assert_allclose(smoothing_rows(17, 2, 2, 0.5) @ y, np.full(17, -1 / 0.25), atol=1e-9)


@pytest.mark.parametrize("recipe", ["STANDARDIZE", "ROBUST", "MSC", "SG-MSC"])
def test_prediction_rows_teach_nothing(spark, x, recipe):
    other = x.copy()
    other[~CAL] += 100
    a, b = ({r.sample_id: r.x for r in pretreat(frame(spark, m, CAL), recipe, AXIS, P).collect()} for m in (x, other))
    for i in np.flatnonzero(CAL):
        np.testing.assert_allclose(a[i], b[i])


def test_degenerate_rows(spark):
    rows = np.vstack([np.full(P, 2.0), np.zeros(P), np.arange(P, dtype=float)])
    df = frame(spark, rows, np.array([True, True, True])).unionByName(spark.createDataFrame([(9, "cal", None), (10, "pred", [1.0])], "sample_id int, role string, x array<double>"))
    for recipe in ("SNV", "VECTOR_NORM", "MINMAX", "MSC", "ROBUST"):
        got = {r.sample_id: r.x for r in pretreat(df, recipe, AXIS, P).collect()}
        assert got[9] is None and got[10] is None
        assert np.isfinite([got[i] for i in range(3)]).all()


def test_unknown_recipe(spark, x):
    with pytest.raises(ValueError):
        pretreat(frame(spark, x, CAL), "WAVELET", AXIS, P)


@pytest.mark.parametrize("p", [4, 9])
def test_few_channels(spark, p):
    x = np.random.default_rng(0).normal(size=(5, p))
    axis = AXIS[:p]
    for recipe in ("SG", "SG1", "DE2"):
        got = pretreat(frame(spark, x, np.ones(5, bool)), recipe, axis, p).orderBy("sample_id").collect()
        want, _ = matrix_form(recipe, x, x, np.array(axis))
        np.testing.assert_allclose([r.x for r in got], want, atol=1e-9)

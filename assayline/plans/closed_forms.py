"""Kernels at fixed settings on small calibrations that SQL can solve.

Every four neighbouring samples are a calibration of their own, three rows to
learn from and one to predict, so that the whole table takes part and every
kernel matrix is 3 x 3: its inverse is a formula, and so are the models.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.functions.columns import or_null
from assayline.operators.kernels import linear, similarity
from assayline.operators.kernels.base import Scale, Standard
from assayline.plans import views
from assayline.plans.views import REFERENCE_SQL, SIGNALS_SQL

Model = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _gp(matern: bool) -> Model:
    def predict(x, z, x2):
        s, own = Standard(x), Scale.fit("standard", z)
        return own.inverse(similarity.gp_mean(s(x), own.forward(z), s(x2), 2.0, 9.0, 0.05, matern))

    return predict


def _pls(x, z, x2):
    b, scale, mean, _ = linear.pls_path(x, z, 1)
    return scale(x2) @ b[0] + mean


def _ridge(x, z, x2):
    s = Standard(x)
    return linear.ridge_path(s(x), z, s(x2), np.array([3.0]))[0]


def _lssvm(x, z, x2):
    s = Standard(x)
    return similarity.lssvm_path(s(x), z, s(x2), [(10.0, 30.0)])[0]


def _elastic(share: float) -> Model:
    """On one channel, where the penalised coefficient is a shrunk covariance."""

    def predict(x, z, x2):
        s = Standard(x[:, 3:4])
        w, mean = linear.elastic_path(s(x[:, 3:4]), z, np.array([0.5]), np.array([share]))
        return (s(x2[:, 3:4]) @ w)[:, 0] + mean

    return predict


MODELS: dict[str, Model] = {
    "pls": _pls,
    "ridge": _ridge,
    "pcr": lambda x, z, x2: linear.pcr_path(x, z, x2, [1])[0],
    "lasso": _elastic(1.0),
    "elasticnet": _elastic(0.25),
    "krr_rbf": lambda x, z, x2: similarity.krr_path(x, z, x2, [(0.5, 0.01)])[0],
    "rbf_ls_svm": _lssvm,
    "gpr_se": _gp(False),
    "gpr_matern32": _gp(True),
}


def fixed(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """(target, sample_id, predicted) of each fourth sample by the model that its three neighbours give."""
    model = MODELS[name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = []
            for rows in b.column("rows").to_pylist():
                x, y = np.array([r["x"] for r in rows]), np.array([r["value"] for r in rows])
                p.append(float(model(x[1:], y[1:], x[:1])[0]))
            yield pa.RecordBatch.from_arrays([b.column("target"), b.column("sample_id"), pa.array(p, pa.float64())], ["target", "sample_id", "predicted"])

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = views.signals(spark, sf_dir).join(views.reference(spark, sf_dir), "sample_id")
        four = rows.groupBy("target", F.floor(F.col("sample_id") / 4).alias("g")).agg(F.sort_array(F.collect_list(F.struct("sample_id", "value", "x"))).alias("rows")).where("size(rows) = 4")
        out = four.select("target", F.col("rows")[0]["sample_id"].alias("sample_id"), "rows").mapInArrow(run, "target string, sample_id bigint, predicted double")
        return out.select("target", "sample_id", (F.round(or_null(F.col("predicted")), 6) + F.lit(0.0)).alias("predicted"))

    return query


# --- the same in SQL -----------------------------------------------------------------------------
_BASE = f"""WITH {SIGNALS_SQL}, {REFERENCE_SQL},
own AS (SELECT sample_id // 4 AS g, sample_id % 4 AS r, pos, v FROM t0 WHERE sample_id // 4 IN (SELECT sample_id // 4 FROM t0 WHERE pos = 0 GROUP BY ALL HAVING count(*) = 4)),
s AS (SELECT g, pos, avg(v) FILTER (r > 0) AS m, stddev_pop(v) FILTER (r > 0) AS sd FROM own GROUP BY ALL),
z AS (SELECT g, r, pos, (v - m) / CASE WHEN sd < 1e-12 THEN 1 ELSE sd END AS z FROM own JOIN s USING (g, pos)),
w AS (SELECT g, pos, max(z) FILTER (r = 0) AS z0, max(z) FILTER (r = 1) AS z1, max(z) FILTER (r = 2) AS z2, max(z) FILTER (r = 3) AS z3 FROM z GROUP BY ALL),
k AS (SELECT g, {", ".join(f"sum(z{i} * z{j}) AS g{i}{j}, sum((z{i} - z{j}) ** 2) AS d{i}{j}" for i, j in ((0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 3)))},
  {", ".join(f"max(z{i}) FILTER (pos = 3) AS x{i}" for i in range(4))} FROM w GROUP BY g),
y AS (SELECT target, sample_id // 4 AS g, {", ".join(f"max(value) FILTER (sample_id % 4 = {i}) AS v{i}" for i in (1, 2, 3))} FROM ref GROUP BY ALL),
c AS (SELECT *, (v1 + v2 + v3) / 3 AS my FROM k JOIN y USING (g)),
b AS (SELECT *, v1 - my AS y1, v2 - my AS y2, v3 - my AS y3, sqrt(((v1 - my) ** 2 + (v2 - my) ** 2 + (v3 - my) ** 2) / 3) AS s0 FROM c),
a AS (SELECT *, CASE WHEN s0 < 1e-12 THEN 1 ELSE s0 END AS sy FROM b),
"""


def solved(right: dict[str, tuple[str, str, str]]) -> str:
    """A^-1 b for each right side b by name, where A is symmetric with entries a11 to a33, as columns name1 to name3."""
    minors = {(1, 1): "(a22 * a33 - a23 * a23)", (1, 2): "(a13 * a23 - a12 * a33)", (1, 3): "(a12 * a23 - a13 * a22)", (2, 2): "(a11 * a33 - a13 * a13)", (2, 3): "(a12 * a13 - a11 * a23)", (3, 3): "(a11 * a22 - a12 * a12)"}
    det = f"(a11 * {minors[1, 1]} + a12 * {minors[1, 2]} + a13 * {minors[1, 3]})"
    return ", ".join(f"({' + '.join(f'{minors[min(i, j), max(i, j)]} * {b[j - 1]}' for j in (1, 2, 3))}) / {det} AS {name}{i}" for name, b in right.items() for i in (1, 2, 3))


def _system(entry: Callable[[str], str], added: str, right: dict[str, tuple[str, str, str]], predicted: str) -> str:
    """Kernel entries from a pair's name ('01'), what the diagonal gets, right sides and the prediction."""
    entries = ", ".join(f"{entry(f'{i}{j}')}{f' + {added}' if i == j else ''} AS a{i}{j}" for i in (1, 2, 3) for j in range(i, 4))
    seen = ", ".join(f"{entry(f'0{j}')} AS k{j}" for j in (1, 2, 3))
    return f"m AS (SELECT *, {entries}, {seen} FROM a), f AS (SELECT *, {solved(right)} FROM m) SELECT target, g * 4 AS sample_id, round({predicted}, 6) + 0.0 AS predicted FROM f"


_CENTRED, _SCALED = ("y1", "y2", "y3"), ("(y1 / sy)", "(y2 / sy)", "(y3 / sy)")
_SUM = "(k1 * u1 + k2 * u2 + k3 * u3)"


def _decay(form: Callable[[str], str]) -> Callable[[str], str]:
    """An entry as a function of the squared distance, which is 0 on the diagonal."""
    return lambda ij: form("0.0" if ij[0] == ij[1] else f"d{ij}")


def _matern(d: str) -> str:
    r = f"(sqrt(3.0::DOUBLE) * sqrt({d}) / 9)"
    return f"2 * (1 + {r}) * exp(-{r})"


def _shrunk(share: float) -> str:
    c = "((x1 * y1 + x2 * y2 + x3 * y3) / 3)"
    gram = "((x1 * x1 + x2 * x2 + x3 * x3) / 3)"
    return f"SELECT target, g * 4 AS sample_id, round(my + x0 * sign({c}) * greatest(abs({c}) - 0.5 * {share}, 0) / ({gram} + 0.5 * {1 - share}), 6) + 0.0 AS predicted FROM a"


def _cross(of: int, with_: Callable[[int], str]) -> str:
    """Row `of` of the Gram matrix times a vector."""
    return " + ".join(f"g{min(of, j)}{max(of, j)} * {with_(j)}" for j in (1, 2, 3))


SQL: dict[str, str] = {
    "pls": _BASE
    + f"""t AS (SELECT *, {", ".join(f"({_cross(i, lambda j: f'y{j}')}) AS t{i}" for i in (0, 1, 2, 3))} FROM a)
SELECT target, g * 4 AS sample_id, round(my + CASE WHEN t1 * t1 + t2 * t2 + t3 * t3 > 1e-18 THEN t0 * (t1 * y1 + t2 * y2 + t3 * y3) / (t1 * t1 + t2 * t2 + t3 * t3) ELSE 0 END, 6) + 0.0 AS predicted FROM t""",
    "ridge": _BASE + _system(lambda ij: f"g{ij}", "3.0", {"u": _CENTRED}, f"my + {_SUM}"),
    # rows and responses are centred, so two eigenvalues of the Gram matrix count: the roots of a quadratic
    "pcr": _BASE
    + f"""e AS (SELECT *, g11 + g22 + g33 AS tr, g11 * g22 - g12 * g12 + g11 * g33 - g13 * g13 + g22 * g33 - g23 * g23 AS minors, {", ".join(f"({_cross(i, lambda j: f'y{j}')}) AS q{i}" for i in (0, 1, 2, 3))} FROM a),
l AS (SELECT *, (tr + sqrt(greatest(tr * tr - 4 * minors, 0))) / 2 AS l1, (tr - sqrt(greatest(tr * tr - 4 * minors, 0))) / 2 AS l2 FROM e)
SELECT target, g * 4 AS sample_id, round(my + (({_cross(0, lambda j: f"q{j}")}) - l2 * q0) / (l1 - l2) / (l1 + 1), 6) + 0.0 AS predicted FROM l""",
    "lasso": _BASE.rstrip().rstrip(",") + "\n" + _shrunk(1.0),
    "elasticnet": _BASE.rstrip().rstrip(",") + "\n" + _shrunk(0.25),
    "krr_rbf": _BASE + _system(_decay(lambda d: f"exp(-0.01::DOUBLE * {d})"), "0.5", {"u": _SCALED}, f"my + sy * {_SUM}"),
    "rbf_ls_svm": _BASE
    + _system(_decay(lambda d: f"exp(-{d} / 60)"), "0.1 + 1e-10", {"p": ("v1", "v2", "v3"), "o": ("1", "1", "1")}, " + ".join(f"k{i} * (p{i} - (p1 + p2 + p3) / (o1 + o2 + o3 - 1e-10) * o{i})" for i in (1, 2, 3)) + " + (p1 + p2 + p3) / (o1 + o2 + o3 - 1e-10)"),
    "gpr_se": _BASE + _system(_decay(lambda d: f"2 * exp(-0.5::DOUBLE * {d} / 81)"), "0.05 + 1e-6", {"u": _SCALED}, f"my + sy * {_SUM}"),
    "gpr_matern32": _BASE + _system(_decay(_matern), "0.05 + 1e-6", {"u": _SCALED}, f"my + sy * {_SUM}"),
}

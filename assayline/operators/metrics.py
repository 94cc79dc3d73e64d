"""Regression metrics, tuning statistics and weights as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayline.functions.columns import EPS, finite, or_null

INF = float("inf")


def _pairs(y: Column, p: Column, where: Column | None) -> tuple[Column, Column]:
    ok = finite(y) & finite(p)
    ok = ok if where is None else where & ok
    return F.when(ok, y), F.when(ok, p)


def rmse(y: Column, p: Column, where: Column | None = None) -> Column:
    """Root mean squared error over pairs that are both finite; +inf without any."""
    y, p = _pairs(y, p, where)
    return F.coalesce(F.sqrt(F.avg((y - p) * (y - p))), F.lit(INF))


def mae(y: Column, p: Column, where: Column | None = None) -> Column:
    """Mean absolute error over pairs that are both finite; +inf without any."""
    y, p = _pairs(y, p, where)
    return F.coalesce(F.avg(F.abs(y - p)), F.lit(INF))


def r2(y: Column, p: Column, where: Column | None = None) -> Column:
    """1 - SSE / SST over finite pairs; null for fewer than two or a constant y. Not a squared correlation."""
    y, p = _pairs(y, p, where)
    ok = (F.count(y) >= 2) & (F.stddev_pop(y) >= EPS)
    return F.when(ok, 1 - F.sum((y - p) * (y - p)) / (F.var_pop(y) * F.count(y)))


def complete_rmse(y: Column, p: Column) -> Column:
    """RMSE that is +inf as soon as one prediction isn't finite."""
    return F.when(F.bool_or(~finite(p)), INF).otherwise(rmse(y, p))


def evaluation(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rc2, Rp2, RMSEC, RMSEP, MAE and RPD for each key of predictions (keys, role, actual, predicted); one shuffle, partial sums map-side."""
    y, p = F.col("actual"), F.col("predicted")
    cal, pred = F.col("role") == "cal", F.col("role") == "pred"
    ok = pred & finite(y) & finite(p)
    got = predictions.groupBy(*keys).agg(
        r2(y, p, cal).alias("Rc2"), r2(y, p, pred).alias("Rp2"), rmse(y, p, cal).alias("RMSEC"), rmse(y, p, pred).alias("RMSEP"), mae(y, p, pred).alias("MAE"),
        F.stddev_pop(F.when(ok, y)).alias("s"), F.count_if(cal).alias("nCalibration"), F.count_if(pred).alias("nPrediction"),
    )
    return got.withColumn("RPD", F.col("s") / F.greatest("RMSEP", F.lit(EPS))).drop("s")


def with_criterion(metrics: DataFrame, rp2_min: float = 0.75, gap: float = 0.20, severe: float = -10.0) -> DataFrame:
    """Adds criterion (Rp2 >= rp2_min and |Rc2 - Rp2| <= gap) and severe (Rp2 < severe); a null metric fails both."""
    ok = (F.col("Rp2") >= rp2_min) & (F.abs(F.col("Rc2") - F.col("Rp2")) <= gap)
    return metrics.withColumn("criterion", F.coalesce(ok, F.lit(False))).withColumn("severe", F.coalesce(F.col("Rp2") < severe, F.lit(False)))


def valid_results(metrics: DataFrame) -> DataFrame:
    """Rows without an error and with a finite RMSEP."""
    errorless = F.col("error").isNull() if "error" in metrics.columns else F.lit(True)
    return metrics.where(errorless & finite(F.col("RMSEP")))


def candidate_statistics(errors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """mean and se of the finite fold errors of each candidate: se is ddof 1 over sqrt n, 0 for one error; +inf both for none."""
    e = or_null(F.col("error"))
    n = F.count(e)
    return errors.groupBy(*keys).agg(
        F.coalesce(F.avg(e), F.lit(INF)).alias("mean"),
        F.when(n == 0, INF).when(n == 1, 0.0).otherwise(F.stddev_samp(e) / F.sqrt(n)).alias("se"),
    )


def one_standard_error(candidates: DataFrame, keys: Sequence[str], enabled: bool = True) -> DataFrame:
    """The chosen row of candidates (keys, idx, complexity, mean, se) for each key.

    The simplest candidate within the best mean plus its se; ties go to the
    lower mean, then the lower idx. Not enabled: the best mean. Keys without a
    finite mean give no row.
    """
    able = candidates.where(finite(F.col("mean")))
    first = W.partitionBy(*keys).orderBy("mean", "idx")
    best = able.withColumn("bound", F.first(F.col("mean") + F.when(finite(F.col("se")), F.col("se")).otherwise(0.0)).over(first.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    order = ["complexity", "mean", "idx"] if enabled else ["mean", "idx"]
    within = best.where(F.col("mean") <= F.col("bound")) if enabled else best
    return within.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("rn = 1").drop("rn", "bound")


def normalised(score: Column, over: W) -> Column:
    """Min-max over a window; non-finite scores count as 0, a flat window gives 0."""
    s = F.when(finite(score), score).otherwise(0.0)
    lo, hi = F.min(s).over(over), F.max(s).over(over)
    return F.when(hi - lo < EPS, 0.0).otherwise((s - lo) / (hi - lo))


def inverse_square_weights(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """weight = rmse ** -2 over the key's sum, rmse floored at EPS."""
    w = F.pow(F.greatest("rmse", F.lit(EPS)), F.lit(-2.0))
    return rows.withColumn("weight", w / F.sum(w).over(W.partitionBy(*keys)))

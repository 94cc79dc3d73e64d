"""Response transforms and their inverses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.config import TRANSFORMS
from assayline.functions.columns import EPS, finite, guarded


def forward(y: Column, transform: str, mean: Column | None = None, sd: Column | None = None) -> Column:
    """raw, log1p, sqrt or standard (with the calibration mean and population deviation)."""
    if transform == "raw":
        return y
    if transform == "log1p":
        return F.log1p(y)
    if transform == "sqrt":
        return F.sqrt(y)
    if transform == "standard":
        return (y - mean) / guarded(sd)
    raise ValueError(f"unknown transform {transform}")


def inverse(z: Column, transform: str, mean: Column | None = None, sd: Column | None = None) -> Column:
    """Back to the response's scale; log1p and sqrt never go below 0."""
    if transform == "raw":
        return z
    if transform == "log1p":
        return F.greatest(F.expm1(z), F.lit(0.0))
    if transform == "sqrt":
        return F.pow(F.greatest(z, F.lit(0.0)), F.lit(2.0))
    if transform == "standard":
        return z * guarded(sd) + mean
    raise ValueError(f"unknown transform {transform}")


def eligible(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, transform, eligible) over rows (keys, value): finite and varying, and nothing negative for log1p and sqrt; standard asks for finite values only."""
    v = F.col("value")
    got = rows.groupBy(*keys).agg(F.bool_and(finite(v)).alias("whole"), (F.max(v) - F.min(v) > 0).alias("varies"), (F.min(v) >= 0).alias("positive"))
    each = got.withColumn("transform", F.explode(F.array(*[F.lit(t) for t in TRANSFORMS])))
    ok = F.when(F.col("transform") == "standard", F.col("whole")).when(F.col("transform") == "raw", F.col("whole") & F.col("varies")).otherwise(F.col("whole") & F.col("varies") & F.col("positive"))
    return each.select(*keys, "transform", F.coalesce(ok, F.lit(False)).alias("eligible"))


def state(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, y_mean, y_sd) of the calibration rows."""
    return rows.where("role = 'cal'").groupBy(*keys).agg(F.avg("value").alias("y_mean"), F.stddev_pop("value").alias("y_sd"))


__all__ = ["EPS", "eligible", "forward", "inverse", "state"]

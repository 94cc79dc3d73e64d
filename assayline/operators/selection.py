"""Variable scores, top-k selection and contiguous windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayline.functions.columns import EPS, finite
from assayline.operators.metrics import normalised


def correlations(long: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, pos, corr): absolute Pearson correlation of each channel with y over calibration rows; 0 where either doesn't vary."""
    cal = long.where("role = 'cal'")
    n = F.count("*")
    flat = (F.sqrt(F.var_pop("v") * n) <= EPS) | (F.sqrt(F.var_pop("y") * n) <= EPS)
    return cal.groupBy(*keys, "pos").agg(F.when(flat, 0.0).otherwise(F.coalesce(F.abs(F.nanvl(F.corr("v", "y"), F.lit(0.0))), F.lit(0.0))).alias("corr"))


def combined_scores(scores: DataFrame, keys: Sequence[str] = (), coefficient_share: float = 0.70) -> DataFrame:
    """scores (keys, pos, coef, corr) with score: shares of both after min-max over each key."""
    w = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    a = normalised(F.abs(F.col("coef")), w)
    b = normalised(F.col("corr"), w)
    return scores.withColumn("score", coefficient_share * a + (1 - coefficient_share) * b)


def top_k(scores: DataFrame, k: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, pos, rank) of the k best scores, the later channel first among equals."""
    s = F.when(finite(F.col("score")), F.col("score")).otherwise(0.0)
    w = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy(s.desc(), F.desc("pos"))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*keys, "pos", "rank")


def contiguous_window(scores: DataFrame, k: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, first, last, total) of the k neighbouring channels of greatest summed score, the first of equals."""
    base = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    frame = base.orderBy("pos").rowsBetween(0, k - 1)
    out = scores.withColumn("total", F.round(F.sum("score").over(frame), 12)).withColumn("size", F.count("*").over(frame)).withColumn("last", F.last("pos").over(frame))
    out = out.where(F.col("size") == k).withColumn("rn", F.row_number().over(base.orderBy(F.desc("total"), "pos"))).where("rn = 1")
    return out.select(*keys, F.col("pos").alias("first"), "last", "total")

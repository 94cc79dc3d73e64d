"""Composite robustness score of a configuration over its splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayline.functions.columns import let, total, uniform
from assayline.operators.quantiles import quantiles
from assayline.sources.shared import durable

COMPONENTS = ("median_rp2", "q10_rp2", "criterion_share", "agreement", "stability", "reliability")


def _clipped(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0))))


def components(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The six components, each from 0 to 1, of metrics (keys, Rc2, Rp2, criterion, severe).

    Their weights are part of a study's specification, their formulas are this
    library's: median and tenth percentile of Rp2, share of splits that meet the
    criterion, 1 - median |Rc2 - Rp2|, 1 - sample deviation of Rp2, and the
    share of splits without severe failure. Quantiles are exact, by brackets.
    """
    metrics = durable(metrics.select(*keys, "Rc2", "Rp2", "criterion", "severe"))
    sums = metrics.groupBy(*keys).agg(F.avg(F.col("criterion").cast("double")).alias("criterion_share"), _clipped(1 - F.stddev_samp("Rp2")).alias("stability"), (1 - F.avg(F.col("severe").cast("double"))).alias("reliability"))
    ranks = quantiles(metrics, keys, "Rp2", {"median_rp2": 0.5, "q10_rp2": 0.1})
    gaps = quantiles(metrics, keys, F.abs(F.col("Rc2") - F.col("Rp2")), {"gap": 0.5})
    out = sums.join(ranks, list(keys), "left").join(gaps, list(keys), "left")
    return out.select(*keys, _clipped(F.col("median_rp2")).alias("median_rp2"), _clipped(F.col("q10_rp2")).alias("q10_rp2"), "criterion_share", _clipped(1 - F.col("gap")).alias("agreement"), "stability", "reliability")


def scored(parts: DataFrame, weights: Sequence[float]) -> DataFrame:
    """parts with crs, the weighted sum."""
    crs = F.lit(0.0)
    for c, w in zip(COMPONENTS, weights, strict=True):
        crs = crs + w * F.col(c)
    return parts.withColumn("crs", crs)


def ranked(parts: DataFrame, target: str, tie: Sequence[str]) -> DataFrame:
    """rank of each configuration within its target by crs."""
    return parts.withColumn("rank", F.row_number().over(W.partitionBy(target).orderBy(F.desc(F.round("crs", 9)), *tie)))


def dirichlet_weights(draw: Column, alpha: Sequence[float], seed: int) -> Column:
    """Dirichlet weights of a draw by number, alpha whole numbers: sums of alpha exponential variables, divided by their total.

    The variables are -ln u of `uniform(seed, draw, component, i)`: any draw can be made
    anywhere, again and alone.
    """
    if any(a != int(a) or a < 1 for a in alpha):
        raise ValueError("alphas must be whole numbers of 1 or more")

    def gamma(c: int, a: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(a)), F.lit(0.0), lambda s, i: s - F.log(uniform(F.lit(seed), draw, F.lit(c), i)))

    gammas = F.array(*[gamma(c, int(a)) for c, a in enumerate(alpha)])
    return let(gammas, lambda g: let(total(g), lambda t: F.transform(g, lambda x: x / t)))


def weight_sensitivity(parts: DataFrame, target: str, tie: Sequence[str], alpha: Sequence[float], draws: int, seed: int, grid: int = 250) -> DataFrame:
    """(target, tie, wins, share): how often each configuration comes first under Dirichlet weights.

    A draw's weights are a function of seed and number (`dirichlet_weights`), made
    by tasks; `draws` rows of six numbers are broadcast. Each configuration
    meets every draw, and the best of a draw is kept map-side, so that a shuffle
    moves at most one row for each draw, target and task.
    """
    spark = parts.sparkSession
    w = dirichlet_weights(F.col("id"), alpha, seed)
    draws_df = spark.range(draws).select(F.floor(F.col("id") / grid).cast("int").alias("g"), F.struct("id", w.alias("w")).alias("d")).groupBy("g").agg(F.sort_array(F.collect_list("d")).alias("ds")).select("g", F.col("ds.w").alias("ws"))
    vec = F.array(*[F.col(c) for c in COMPONENTS])
    # each configuration's scores under the draws of one group; the best by draw is found by position, map-side first
    each = parts.select(target, *tie, vec.alias("v")).crossJoin(F.broadcast(draws_df))  # `draws` weights in all
    score = F.transform("ws", lambda w: F.round(F.aggregate(F.zip_with(w, F.col("v"), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x), 9))
    long = each.select(target, *tie, "g", F.posexplode(score).alias("d", "score"))
    best = long.groupBy(target, "g", "d").agg(F.max(F.struct("score", *[F.col(t) for t in tie])).alias("b"))
    return best.groupBy(target, *[F.col(f"b.{t}").alias(t) for t in tie]).agg(F.count("*").alias("wins")).withColumn("share", F.col("wins") / draws)

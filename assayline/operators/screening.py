"""Monte-Carlo cross-validation screening: errors, thresholds and the acceptance guard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.functions.columns import finite, half_even
from assayline.operators.quantiles import quantiles
from assayline.sources.shared import durable


def mean_errors(errors: DataFrame) -> DataFrame:
    """(target, sample_id, mean_error, n_predicted) of errors (target, sample_id, abs_error); rows that aren't finite are left out."""
    return errors.where(finite(F.col("abs_error"))).groupBy("target", "sample_id").agg(F.avg("abs_error").alias("mean_error"), F.count("*").alias("n_predicted"))


def thresholds(means: DataFrame) -> DataFrame:
    """(target, n, med, mad, threshold): median + 3 MAD, the MAD unscaled; exact medians by brackets, so a target may be of any size."""
    means = durable(means.select("target", "mean_error"))
    med = quantiles(means, ["target"], "mean_error", {"med": 0.5})
    off = means.join(med, "target").select("target", F.abs(F.col("mean_error") - F.col("med")).alias("off"))
    mad = quantiles(off, ["target"], "off", {"mad": 0.5})
    n = means.groupBy("target").agg(F.count("*").alias("n"))
    return n.join(med, "target").join(mad, "target").select("target", "n", "med", "mad", (F.col("med") + 3 * F.col("mad")).alias("threshold"))


def screen(means: DataFrame, max_ratio: float = 0.18, least_kept: int = 8, least_n: int = 15, floor: int = 10) -> DataFrame:
    """means with threshold, candidate, applied and keep.

    Candidates lie above the threshold. They are left out only if at most
    max(floor, half-even max_ratio * n) are, and least_kept samples remain;
    targets of fewer than least_n samples keep all.
    """
    limits = thresholds(means)
    flagged = means.join(limits, "target").withColumn("candidate", F.col("mean_error") > F.col("threshold"))
    counts = flagged.groupBy("target").agg(F.count_if("candidate").alias("n_candidates"))
    out = flagged.join(counts, "target")
    allowed = F.greatest(F.lit(floor), half_even(max_ratio * F.col("n")))
    applied = (F.col("n") >= least_n) & (F.col("n_candidates") <= allowed) & (F.col("n") - F.col("n_candidates") >= least_kept)
    return out.withColumn("applied", applied).withColumn("keep", ~(F.col("candidate") & F.col("applied")))

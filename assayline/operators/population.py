"""Sample alignment, populations, exclusions and variable masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.functions.columns import EPS, finite

DEFAULT_REASON = "PredeclaredIndependentQCExclusion"


def align(spectra: DataFrame, reference: DataFrame, least: int = 8) -> DataFrame:
    """spectra (sample_id, ...) joined with reference (target, sample_id, value); a reference named twice counts as last given (seq).

    Raises if fewer than `least` samples are common; one count reaches the driver.
    """
    last = reference
    if "seq" in reference.columns:
        last = reference.groupBy("target", "sample_id").agg(F.max_by("value", "seq").alias("value"))
    common = spectra.select("sample_id").intersect(last.select("sample_id"))
    if (n := common.limit(least).count()) < least:
        raise ValueError(f"{n} common samples; at least {least} are needed")
    return spectra.join(last, "sample_id")


def resolve_population(reference: DataFrame, manifest: DataFrame, wildcard: str = "*", strict: bool = False) -> DataFrame:
    """Every (target, sample) of reference (target, sample_id, value) with excluded and reasons.

    manifest: target (or the wildcard), sample_id, reason, seq; only rows whose
    status, if it has one, is 'excluded' count. The reason given last holds;
    blank ones take the default. A value that isn't finite excludes too; with
    strict, one that no row of the manifest gives a reason of its own for is an
    error that names some such samples.
    """
    m = manifest.where("lower(status) = 'excluded'") if "status" in manifest.columns else manifest
    reason = F.when(F.trim(F.coalesce("reason", F.lit(""))) == "", DEFAULT_REASON).otherwise(F.trim("reason"))
    m = m.select(F.trim("target").alias("m_target"), F.trim("sample_id").alias("sample_id"), reason.alias("reason"), (F.trim(F.coalesce("reason", F.lit(""))) != "").alias("given"), "seq")
    # two equality joins in place of one OR, so that both stay hash joins
    own = m.where(F.col("m_target") != wildcard).withColumnRenamed("m_target", "target")
    everywhere = m.where(F.col("m_target") == wildcard).drop("m_target")
    declared = own.unionByName(everywhere.join(reference.select("target", "sample_id").distinct(), "sample_id").select("target", "sample_id", "reason", "given", "seq"))
    declared = declared.groupBy("target", "sample_id").agg(F.max_by("reason", "seq").alias("reason"), F.max_by("given", "seq").alias("given"))
    rows = reference.join(declared, ["target", "sample_id"], "left")
    missing = ~finite(F.col("value"))
    if strict:
        bare = rows.where(missing & ~F.coalesce("given", F.lit(False))).select("target", "sample_id").limit(20).collect()
        if bare:
            raise ValueError(f"missing reference values without a reason for their exclusion, among others: {[tuple(r) for r in bare]}")
    reasons = F.concat_ws("; ", F.when(missing, "MissingReferenceValue"), F.col("reason"))
    return rows.select("target", "sample_id", "value", (missing | F.col("reason").isNotNull()).alias("excluded"), reasons.alias("reasons"))


def retained(population: DataFrame) -> DataFrame:
    return population.where("not excluded").select("target", "sample_id", "value")


def screenable(reference: DataFrame, least: int = 8) -> DataFrame:
    """(target, n, sd, status): 'ok', or 'not_screened' with fewer than `least` finite values or no variation."""
    v = F.when(finite(F.col("value")), F.col("value"))
    got = reference.groupBy("target").agg(F.count(v).alias("n"), F.stddev_pop(v).alias("sd"))
    return got.withColumn("status", F.when((F.col("n") < least) | (F.coalesce("sd", F.lit(0.0)) < EPS), "not_screened").otherwise("ok"))


def usable_variables(long: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, pos) of the channels all of whose calibration values are finite and vary; long: keys, role, pos, v."""
    ok = finite(F.col("v"))
    got = long.where("role = 'cal'").groupBy(*keys, "pos").agg(F.bool_and(ok).alias("whole"), F.stddev_pop(F.when(ok, F.col("v"))).alias("sd"))
    return got.where(F.col("whole") & (F.col("sd") > EPS)).select(*keys, "pos")

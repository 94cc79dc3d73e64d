"""Whole programs: a study from files to result tables, and a screen from files to its workbook."""

from __future__ import annotations

import importlib.metadata
import json
import platform
from dataclasses import asdict

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline import __version__
from assayline.config import Config
from assayline.operators import population
from assayline.plans import progress, study, validate
from assayline.sources import digests, results, tables, workbook


def load(spark: SparkSession, spectra_path: str, reference_path: str) -> tuple[DataFrame, DataFrame, list[float]]:
    """Spectra, reference and axis of two wide tables, aligned by sample name; fewer than 8 common samples are an error."""
    spectra, axis = tables.spectra(tables.read_wide(spark, spectra_path))
    reference = tables.reference(tables.read_wide(spark, reference_path)).select("target", "target_no", "sample_id", "seq", "value")
    population.align(spectra.select("sample_id"), reference.select("target", "sample_id", "value"))
    last = reference.groupBy("target", "target_no", "sample_id").agg(F.max_by("value", "seq").alias("value"))
    return spectra, last.join(spectra.select("sample_id"), "sample_id", "left_semi"), axis


def run_metadata(spark: SparkSession, config: Config, signature: str, inputs: tuple[str, ...] = (), observed: DataFrame | None = None) -> DataFrame:
    """(key, value, saved_at): versions, settings, SHA-256 of the input files and the figures observed for each target."""
    rows = [("signature", signature), ("version", __version__), ("spark", pyspark.__version__), ("python", platform.python_version()), ("evaluations_per_target", str(config.evaluations)), ("random_state", str(config.random_state)), ("settings", json.dumps(asdict(config), default=str))]
    rows += [(f"library_{n}", importlib.metadata.version(n)) for n in ("numpy", "pandas", "pyarrow")] + [("system", platform.platform()), ("machine", platform.machine()), ("java", spark.sparkContext._jvm.System.getProperty("java.version")), ("master", spark.sparkContext.master)]
    out = spark.createDataFrame(rows, "key string, value string")
    if inputs:
        out = out.unionByName(digests.file_digests(spark, *inputs).select(F.concat(F.lit("sha256 "), "path").alias("key"), F.col("sha256").alias("value")))
    if observed is not None:
        figures = F.array(*[F.struct(F.concat(F.lit(f"{c} "), "target").alias("key"), F.col(c).cast("string").alias("value")) for c in ("tasks", "failures", "warnings")])
        out = out.unionByName(observed.select(F.inline(figures)))
    return out.withColumn("saved_at", F.current_timestamp())


def run_files(spark: SparkSession, spectra_path: str, reference_path: str, config: Config, folder: str, exclusions_path: str | None = None) -> dict[str, DataFrame]:
    """A resumable study from files: results by target in folder/results, the result and audit tables returned.

    Targets run one after another, each of them all over the cluster, so that
    what is done of a study that breaks off is whole targets. Where the full
    factorial is required, missing or failed tasks are an error at the end.
    Tasks, failures and warnings are counted while a target runs. The audit set,
    CSV with a byte order mark, goes to folder/audit.
    """
    spectra, reference, axis = load(spark, spectra_path, reference_path)
    audit = population.resolve_population(reference, tables.exclusions(spark, exclusions_path), strict=config.require_reason_for_missing)
    kept = population.retained(audit)
    able = population.screenable(kept).where("status = 'ok'").select("target")
    store = results.Store(spark, folder, config.signature(**results.provenance(spectra, kept)))
    done = store.load()
    targets = [r.target for r in able.collect()]  # the study's analytes
    finished = set() if done is None else {r.target for r in done.select("target").distinct().collect()}
    for target in sorted(set(targets) - finished):
        rows, watch = progress.observed(study.run_study(spectra, kept.where(F.col("target") == target), axis, config), [target], F.col("error").isNotNull(), F.size("warning_messages"))
        store.save(rows)
        store.note(progress.figures(spark, watch, [target]))
    found = store.load()
    if config.require_full_factorial and (short := study.incomplete(found, config).collect()):  # a row a target
        raise RuntimeError(f"the factorial isn't whole: {[tuple(r) for r in short]}; what ran is kept in {folder}")
    order = reference.groupBy("target").agg(F.min("target_no").alias("ordinal"))
    out = study.summarise(found, config, axis, order, audit)
    inputs = tuple(p for p in (spectra_path, reference_path, exclusions_path) if p)
    out |= {"PredeclaredExclusionAudit": audit.where("excluded"), "RunMetadata": run_metadata(spark, config, store.signature, inputs, store.notes())}
    results.write_tables({k: v for k, v in out.items() if k != "TopRuns"}, f"{folder}/audit", "csv", mark=True)
    return out


def validate_files(spark: SparkSession, folder: str, specification_path: str, config: Config, manifest_path: str | None = None, included: dict[str, int] | None = None, total: int = 0, max_bytes: int = 25 * 1024 * 1024) -> DataFrame:
    """(check_name, expected, actual, passed): every check of a package of files, whether it passes or not.

    No file of the folder has max_bytes or more, none has forbidden characters;
    the JSON specification (recipes, transforms, algorithms, ratios, repeats)
    agrees with the settings in each entry it has; a manifest (CSV with
    abbreviation and status) has as many included samples of each analyte as
    `included` says and `total` of each in all.
    """
    found = validate.file_report(tables.files(spark, folder), max_bytes)
    one = found.agg(F.count_if("too_large").alias("large"), F.count_if("forbidden_text").alias("forbidden"))
    rows = [validate.check(one.select(F.col("large").alias("actual")), "files_too_large", "0"), validate.check(one.select(F.col("forbidden").alias("actual")), "files_with_forbidden_text", "0")]
    spec = tables.specification(spark, specification_path)
    for name in ("recipes", "transforms", "algorithms", "ratios", "repeats"):
        if name in spec.columns:
            want = getattr(config, name)
            rows.append(validate.check(spec.select(F.to_json(F.struct(F.col(name).alias("v"))).alias("actual")), f"specification_{name}", json.dumps({"v": want}, separators=(",", ":"))))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    if manifest_path:
        counts = validate.published_counts(tables.read_wide(spark, manifest_path), included or {}, total)
        both = F.concat_ws(" of ", "included", (F.col("included") + F.col("excluded")).cast("string"))
        out = out.unionByName(counts.select(F.concat(F.lit("samples "), "abbreviation").alias("check_name"), F.concat_ws(" of ", "expected", F.lit(total)).alias("expected"), both.alias("actual"), "passed"))
    return out


def screen_files(spark: SparkSession, spectra_path: str, reference_path: str, config: Config, workbook_path: str | None = None, manifest_folder: str | None = None) -> dict[str, DataFrame]:
    """The Monte-Carlo screen from files; Summary, Manifest and Diagnostics, also as a workbook if a local path is given; the manifest as CSV with a byte order mark in manifest_folder/Manifest."""
    spectra, reference, _ = load(spark, spectra_path, reference_path)
    out = study.mccv_screen(spectra.select("sample_id", "x"), reference.select("target", "sample_id", "value"), config)
    if workbook_path:
        workbook.write_sheets(workbook_path, out)
    if manifest_folder:
        results.write_tables({"Manifest": out["Manifest"]}, manifest_folder, "csv", mark=True)
    return out

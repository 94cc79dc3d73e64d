"""The factorial study and the Monte-Carlo screen as distributed plans."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.config import Config, stable_seed
from assayline.operators import metrics, population, ranking, screening, splits
from assayline.operators.evaluate import evaluate_all, screened
from assayline.operators.kernels import registry
from assayline.operators.kernels.linear import pls_path

RESULT = (
    "target string, outer_split_id int, train_ratio double, repeat_id int, preprocess string, y_transform string, algorithm string, split_id bigint, "
    "Rc2 double, Rp2 double, RMSEC double, RMSEP double, MAE double, RPD double, n_samples int, n_calibration int, n_prediction int, n_features int, "
    "channels array<int>, screened_out array<string>, predictions array<struct<sample_id:string,role:string,actual:double,predicted:double>>, warning_messages array<string>, elapsed_sec double, error string"
)

_FIELDS = RESULT.replace("array<struct<sample_id:string,role:string,actual:double,predicted:double>>", "array").split(", ")


def run_study(spectra: DataFrame, reference: DataFrame, axis: Sequence[float], config: Config, done: DataFrame | None = None, tasks_per_group: int = 64) -> DataFrame:
    """One row (RESULT) for each task of the factorial, for every target of reference.

    spectra: sample_id, x array<double> in the order of axis; reference: target,
    sample_id, value, already without excluded samples. A split's recipes and
    transforms are dealt to groups of about tasks_per_group tasks. Only keys and
    values of the groups' samples are shuffled; spectra join them where they
    lie, broadcast by Spark if below its size bound, or shuffled once a group,
    not once a task. Pretreatment and channel scores are made once for all
    algorithms of a recipe and transform. A group is a function of its key and
    settings alone: lost tasks are simply run again with the same result. done:
    rows whose (target, outer_split_id, preprocess, y_transform, algorithm) need
    no run. With config.screen_calibration each split's calibration rows are
    screened first; those that go are in screened_out and in no model. Rows with
    another number of channels than the axis are left out, failures are rows
    with an error.
    """
    config.validate()
    units = [(p, t) for p in config.recipes for t in config.transforms]
    groups = min(len(units), max(1, -(-len(units) * len(config.algorithms) // tasks_per_group)))
    key = ["target", "outer_split_id", "part"]
    rows = splits.outer_splits(reference, config).join(reference, ["target", "sample_id"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    total = reference.select("target").distinct().count() * len(config.ratios) * config.repeats * groups
    wanted = spectra.where(F.size("x") == len(axis)).select("sample_id", "x")
    # far more tasks than groups, so that hardly two groups share one; a number asked for isn't coalesced
    tasks = max(1, min(16 * total, 10_000))
    # the second time is for a join that dealt the rows by sample; after a broadcast Spark leaves it out
    dealt = rows.repartition(tasks, *key).join(wanted, "sample_id").repartition(tasks, *key)
    dealt = dealt.select(*key, "train_ratio", "repeat_id", F.col("sample_id").cast("string").alias("sample_id"), "role", "value", "x")
    channels = np.asarray(axis, float)

    def run(k, pdf, finished):
        target, split, part = k
        pdf = pdf.sort_values("sample_id")
        names, roles = pdf["sample_id"].tolist(), pdf["role"].to_numpy()
        y, x, cal = pdf["value"].to_numpy(float), np.array(pdf["x"].tolist(), float), roles == "cal"
        ratio, repeat = float(pdf["train_ratio"].iloc[0]), int(pdf["repeat_id"].iloc[0])
        n_raw, gone, trouble = int(cal.sum()), [], None
        if config.screen_calibration:
            try:
                keep = ~cal
                keep[cal] = screened(x[cal], y[cal], config, stable_seed(config.random_state, "calibration_outliers", split))
                gone = [n for n, ok in zip(names, keep, strict=True) if not ok]
                names, roles, y, x, cal = [n for n, ok in zip(names, keep, strict=True) if ok], roles[keep], y[keep], x[keep], cal[keep]
            except Exception as e:
                trouble = f"{type(e).__name__}: {e}"[:500]
        out = []
        for recipe, transform in units[part::groups]:
            todo = [a for a in config.algorithms if (recipe, transform, a) not in finished]
            if trouble:
                results = [{"error": trouble, "warnings": [], "elapsed": 0.0}] * len(todo)
            else:
                results = evaluate_all(x, y, cal, recipe, transform, todo, channels, config, lambda a, p=recipe, t=transform: (target, split, t, p, a))
            for algorithm, got in zip(todo, results, strict=True):
                p = got.get("predicted")
                predictions = [] if p is None else [{"sample_id": a, "role": b, "actual": float(c), "predicted": float(d)} for a, b, c, d in zip(names, roles, y, p, strict=True)]
                own = got.get("channels")
                number = ((config.transforms.index(transform) * len(config.recipes) + config.recipes.index(recipe)) * len(config.ratios) + config.ratios.index(ratio)) * config.repeats + repeat
                out.append(
                    {"target": target, "outer_split_id": split, "train_ratio": ratio, "repeat_id": repeat, "preprocess": recipe, "y_transform": transform, "algorithm": algorithm, "split_id": number}
                    | {m: got.get(m) for m in ("Rc2", "Rp2", "RMSEC", "RMSEP", "MAE", "RPD")}
                    | {"n_samples": n_raw + int((~cal).sum()), "n_calibration": int(cal.sum()), "n_prediction": int((~cal).sum()), "n_features": 0 if own is None else len(own), "channels": [] if own is None else own.tolist(), "screened_out": gone}
                    | {"predictions": predictions, "warning_messages": got["warnings"], "elapsed_sec": got["elapsed"], "error": got["error"]}
                )
        return pd.DataFrame(out, columns=[f.split(" ")[0] for f in _FIELDS])

    if done is None:
        return dealt.groupBy(*key).applyInPandas(lambda k, pdf: run(k, pdf, set()), RESULT)
    at = [F.array_position(F.array(*map(F.lit, v)), c) - 1 for v, c in ((config.recipes, F.col("preprocess")), (config.transforms, F.col("y_transform")))]
    part = ((at[0] * len(config.transforms) + at[1]) % groups).cast("int")
    had = done.where(F.col("preprocess").isin(*config.recipes) & F.col("y_transform").isin(*config.transforms)).select("target", F.col("outer_split_id").cast("int").alias("outer_split_id"), part.alias("part"), "preprocess", "y_transform", "algorithm").distinct()  # of one type, as both sides are dealt by hash

    def rest(k, pdf, finished):
        if pdf.empty:
            return pd.DataFrame(columns=[f.split(" ")[0] for f in _FIELDS])
        return run(k, pdf, set(zip(finished["preprocess"], finished["y_transform"], finished["algorithm"], strict=True)))

    return dealt.groupBy(*key).cogroup(had.groupBy(*key)).applyInPandas(rest, RESULT)


def incomplete(results: DataFrame, config: Config) -> DataFrame:
    """(target, expected, found, failed) of the targets whose factorial isn't whole."""
    got = results.groupBy("target").agg(F.count("*").alias("found"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    return got.withColumn("expected", F.lit(config.evaluations)).where((F.col("found") != F.col("expected")) | (F.col("failed") > 0))


def summarise(results: DataFrame, config: Config, axis: Sequence[float] | None = None, targets: DataFrame | None = None, population: DataFrame | None = None) -> dict[str, DataFrame]:
    """The result and audit tables of a study by name.

    axis: the channels' shifts, for the variable manifest. targets (target,
    ordinal): the order of the result tables. population (target, sample_id,
    excluded): who was left out before the study, for the outlier manifest.
    """
    named = results.select(
        "target", F.col("algorithm").alias("modelName"), "preprocess", F.col("y_transform").alias("yTransform"), F.col("train_ratio").alias("trainRatio"), F.col("repeat_id").alias("repeatId"), F.col("split_id").alias("splitId"),
        "Rc2", "Rp2", "RMSEC", "RMSEP", "MAE", "RPD", F.col("n_samples").alias("nSamples"), F.col("n_features").alias("nFeatures"), F.col("n_features").alias("nEffectiveVariables"), F.col("elapsed_sec").alias("elapsedSec"),
        "error", "outer_split_id", "predictions", "channels", "warning_messages", "screened_out", "n_calibration", "n_prediction",
    )
    good = metrics.valid_results(named)
    all_runs = ranking.fixed_schema(good, ranking.METRIC_COLUMNS)
    keys = ["target", "modelName", "preprocess", "yTransform", "trainRatio", "repeatId", "splitId"]
    detail = good.select(*keys, "Rc2", "Rp2", "RMSEC", "RMSEP", "MAE", "RPD", F.inline("predictions"))
    detail = ranking.prediction_details(detail).select("*", F.col("sample_id").alias("sampleName"), F.col("actual").alias("actualValue"), F.col("predicted").alias("predictedValue"))
    names = F.array_join(F.transform(F.filter("predictions", lambda p: p.role == "pred"), lambda p: p.sample_id), ",")
    cal_names = F.array_join(F.transform(F.filter("predictions", lambda p: p.role == "cal"), lambda p: p.sample_id), ",")
    ordered, details_ordered = (lambda t: t, lambda t: t) if targets is None else (lambda t: ranking.export_order(t, targets), lambda t: ranking.prediction_order(t, targets))
    path = F.when(F.col("modelName").isin(*registry.CONTIGUOUS), f"contiguous{config.feature_count}").otherwise(f"ranked{config.feature_count}")
    shifts = F.transform("channels", lambda c: F.format_string("%.6f", F.get(F.array(*[F.lit(float(v)) for v in axis]), c))) if axis is not None else F.array().cast("array<string>")
    outliers = named.select("target", "outer_split_id", "trainRatio", "repeatId", "splitId", F.col("nSamples").alias("nOuterPopulationSamples"), (F.col("n_calibration") + F.size("screened_out")).alias("nCalibrationRaw"), F.col("n_calibration").alias("nCalibrationUsed"), F.size("screened_out").alias("nCalibrationExcluded"), F.array_join("screened_out", ",").alias("calibrationExcludedNames"), F.col("n_prediction").alias("nPrediction"))
    outliers = ranking.first_of_each(outliers, ["target", "outer_split_id"], ["splitId"]).drop("splitId").withColumnRenamed("outer_split_id", "outerSplitId")
    if population is not None:
        before = population.groupBy("target").agg(F.count("*").alias("nOriginalSamples"), F.count_if("excluded").alias("nPresearchExcluded"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("excluded"), F.col("sample_id").cast("string")))), ",").alias("presearchExcludedNames"))
        outliers = outliers.join(before, "target", "left")
    return {
        "BestSummary": ordered(ranking.best_by(all_runs, ["target"])),
        "BestByTargetAlgorithm": ordered(ranking.best_by(all_runs, ["target", "modelName"])),
        "AllRunMetrics": all_runs,
        "PredictionDetails": details_ordered(ranking.fixed_schema(detail, ranking.PREDICTION_COLUMNS)),
        "OutlierManifest": outliers,
        "SplitManifest": ranking.first_of_each(good.select("target", "outer_split_id", "trainRatio", "repeatId", "splitId", cal_names.alias("calibrationSamples"), names.alias("predictionSamples")), ["target", "outer_split_id"], ["splitId"]).drop("splitId").withColumnRenamed("outer_split_id", "outerSplitId"),
        "SelectedVariableManifest": ranking.first_of_each(good.select("target", "outer_split_id", "splitId", "trainRatio", "repeatId", "yTransform", "preprocess", path.alias("featurePath"), "nFeatures", F.array_join("channels", ",").alias("selectedVariableIndices"), F.array_join(shifts, ",").alias("selectedRamanShifts_cm-1")), ["target", "outer_split_id", "yTransform", "preprocess", "featurePath"], ["splitId"]).withColumnRenamed("outer_split_id", "outerSplitId"),
        "RunWarnings": named.where(F.size("warning_messages") > 0).select(*keys, F.col("outer_split_id").alias("outerSplitId"), F.size("warning_messages").alias("warningCount"), F.array_join("warning_messages", " | ").alias("warningMessages")),
        "RunFailures": named.where(F.col("error").isNotNull()).select(*keys, F.col("outer_split_id").alias("outerSplitId"), "error"),
        "TopRuns": ranking.top_n(all_runs, config.top_n),
    }


def _held_out_errors(x: np.ndarray, y: np.ndarray, target: str, iteration: int, config: Config, require_success: bool) -> tuple[list[int], list[float]]:
    """Positions held out by one iteration and their absolute errors; none if its fit fails."""
    n = len(y)
    for attempt in range(5 if require_success else 1):
        order = np.random.default_rng(stable_seed(config.random_state, "mccv", target, iteration, attempt)).permutation(n)
        cut = max(8, round(config.mccv_calibration * n))
        tr, te = order[:cut], order[cut:]
        k = min(config.max_pls_components, x.shape[1], len(tr) - 2)
        if len(te) < 3 or k < 1:
            return [], []
        b, scale, mean, _ = pls_path(x[tr], y[tr], k)
        p = scale(x[te]) @ b[-1] + mean
        if np.isfinite(p).all():
            return te.tolist(), np.abs(y[te] - p).tolist()
    if require_success:
        raise RuntimeError(f"{target}, iteration {iteration}: no fit succeeded")
    return [], []


def mccv_errors(spectra: DataFrame, reference: DataFrame, config: Config, require_success: bool = False) -> DataFrame:
    """(target, iteration, sample_id, abs_error): held-out absolute errors of PLS models on random calibration subsets.

    Each (target, iteration) has a seed of its own, and a task takes some 25
    iterations, so that a target's rows are sent out once for those. A failed fit
    leaves its iteration out, or, with require_success, is tried again with
    further seeds up to five times and then raises. Targets of fewer than 15
    samples give no rows.
    """
    rows = reference.join(spectra, "sample_id")
    blocks = rows.groupBy("target").agg(F.sort_array(F.collect_list(F.struct(F.col("sample_id").cast("string").alias("sample_id"), "value", "x"))).alias("rows")).where(F.size("rows") >= 15)
    each = 25
    parts = max(1, -(-config.mccv_iterations // each))
    tasks = reference.select("target").distinct().count() * parts
    plan = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(max(1, min(tasks, 10_000)), "target", "part")

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                names = [s["sample_id"] for s in r["rows"]]
                y, x = np.array([s["value"] for s in r["rows"]], float), np.array([s["x"] for s in r["rows"]], float)
                for iteration in range(r["part"], config.mccv_iterations, parts):
                    te, errors = _held_out_errors(x, y, r["target"], iteration, config, require_success)
                    out += [(r["target"], iteration, names[i], e) for i, e in zip(te, errors, strict=True)]
            if out:
                yield pd.DataFrame(out, columns=["target", "iteration", "sample_id", "abs_error"])

    return plan.mapInPandas(run, "target string, iteration int, sample_id string, abs_error double")


def mccv_screen(spectra: DataFrame, reference: DataFrame, config: Config) -> dict[str, DataFrame]:
    """Summary, Manifest and Diagnostics of the screen of every target of reference (target, sample_id, value)."""
    finite_rows = population.resolve_population(reference.withColumn("sample_id", F.col("sample_id").cast("string")), reference.sparkSession.createDataFrame([], "target string, sample_id string, reason string, seq int"))
    kept = population.retained(finite_rows)
    able = population.screenable(kept).where("status = 'ok'").select("target")
    wide = spectra.withColumn("sample_id", F.col("sample_id").cast("string"))
    judged = screening.screen(screening.mean_errors(mccv_errors(wide, kept.join(able, "target"), config)), config.max_outlier_ratio)
    diagnostics = kept.join(judged, ["target", "sample_id"], "left")
    keep = F.coalesce("keep", F.lit(True))
    diagnostics = diagnostics.select("target", F.col("sample_id").alias("sampleName"), F.col("value").alias("referenceValue"), F.col("mean_error").alias("meanAbsolutePredictionError"), F.coalesce("n_predicted", F.lit(0)).alias("predictionCount"), F.coalesce("candidate", F.lit(False)).alias("candidateOutlier"), keep.alias("finalKeep"), "threshold", F.col("med").alias("medianMeanAbsolutePredictionError"), F.col("mad").alias("MAD"), F.coalesce("applied", F.lit(False)).alias("applied"))
    status = F.when(F.col("threshold").isNull(), "not_screened").when(F.col("finalKeep"), "included").otherwise("excluded")
    manifest = diagnostics.select("target", "sampleName", "referenceValue", status.alias("status"), "candidateOutlier", "meanAbsolutePredictionError", "threshold", "predictionCount", F.when(~F.col("finalKeep"), "mean error above median + 3 MAD").otherwise("").alias("reason"))
    out = ~F.col("finalKeep")
    summary = diagnostics.groupBy("target").agg(
        F.count("*").alias("nOriginalValid"), F.count_if(F.col("finalKeep")).alias("nRetained"), F.count_if(out).alias("nExcluded"), F.count_if("candidateOutlier").alias("nCandidateOutliers"),
        F.array_join(F.sort_array(F.collect_list(F.when(out, F.col("sampleName")))), ",").alias("excludedSampleNames"), F.max("medianMeanAbsolutePredictionError").alias("medianMeanAbsError"), F.max("MAD").alias("MADMeanAbsError"), F.max("threshold").alias("thresholdMedianPlus3MAD"), F.bool_or("applied").alias("filterApplied"),
    )
    settings = {"mccvIterations": config.mccv_iterations, "temporaryCalibrationRatio": config.mccv_calibration, "maxPLSComponents": config.max_pls_components, "randomState": config.random_state}
    for k, v in settings.items():
        summary = summary.withColumn(k, F.lit(v))
    return {"Summary": summary, "Manifest": manifest, "Diagnostics": diagnostics.drop("applied")}

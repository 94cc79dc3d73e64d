"""Files, whole studies, screens and the resumable store."""

import hashlib

import numpy as np
import pytest

from assayline.config import Config
from assayline.operators import ranking
from assayline.plans import reports, study, validate
from assayline.sources import results, tables, workbook

N, P = 32, 12


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("study")
    rng = np.random.default_rng(3)
    t = rng.normal(size=(N, 2))
    x = t @ rng.normal(size=(2, P)) + 0.02 * rng.normal(size=(N, P)) + 5
    y = 10 + t[:, 0]
    ids = [f"S{i + 1}" for i in range(N)]
    (at / "spectra.csv").write_text("﻿shift," + ",".join(ids) + "\n" + "\n".join(f"{200 + 2.5 * j}," + ",".join(str(v) for v in x[:, j]) for j in range(P)) + "\n", encoding="utf-8")
    (at / "reference.csv").write_text("Analyte," + ",".join(ids) + "\nEA," + ",".join(map(str, y)) + "\n," + ",".join(["oops", *map(str, y[1:])]) + "\n")
    (at / "excluded.csv").write_text("analyte,sample_id,status,exclusion_reason\nEA,S1,excluded,bad\nEA,S2,included,\n")
    return at


CFG = Config(algorithms=("PLS", "Ridge", "XGBoost"), recipes=("RAW", "SNV"), transforms=("raw",), ratios=(0.75,), repeats=1, require_full_factorial=False, feature_count=8)


def test_files(spark, folder):
    spectra, axis = tables.spectra(tables.read_wide(spark, str(folder / "spectra.csv")))
    assert axis == [200 + 2.5 * j for j in range(P)] and spectra.count() == N
    ref = tables.reference(tables.read_wide(spark, str(folder / "reference.csv")))
    assert {r.target for r in ref.select("target").distinct().collect()} == {"EA", "Analyte2"}
    assert ref.where("value is null").count() == 1
    assert [tuple(r)[:3] for r in tables.exclusions(spark, str(folder / "excluded.csv")).collect()] == [("EA", "S1", "bad")]
    assert tables.exclusions(spark, None).count() == 0


def test_study_resumes(spark, folder, tmp_path):
    paths = (str(folder / "spectra.csv"), str(folder / "reference.csv"))
    out = reports.run_files(spark, *paths, CFG, str(tmp_path / "out"), str(folder / "excluded.csv"))
    assert out["AllRunMetrics"].count() == 8 and out["BestSummary"].count() == 2 and out["RunFailures"].count() == 4
    assert out["PredictionDetails"].where("target = 'EA'").select("sampleName").distinct().count() == N - 1
    assert {r.reasons for r in out["PredeclaredExclusionAudit"].collect()} == {"bad", "MissingReferenceValue"}
    again = reports.run_files(spark, *paths, CFG, str(tmp_path / "out"), str(folder / "excluded.csv"))
    a, b = (sorted(map(tuple, o["AllRunMetrics"].collect()), key=repr) for o in (out, again))
    assert a == b
    with pytest.raises(ValueError):
        reports.run_files(spark, *paths, Config(**{**CFG.__dict__, "random_state": 1}), str(tmp_path / "out"))
    meta = {r.key: r.value for r in again["RunMetadata"].collect()}  # the figures of the run that did the work
    assert (meta["tasks EA"], meta["failures EA"], meta["failures Analyte2"]) == ("6", "2", "2")
    assert meta["warnings EA"] == str(sum(r.warningCount for r in out["RunWarnings"].where("target = 'EA'").collect()))
    files = [folder / n for n in ("spectra.csv", "reference.csv", "excluded.csv")]
    assert sorted(v for k, v in meta.items() if k.startswith("sha256 ")) == sorted(hashlib.sha256(f.read_bytes()).hexdigest() for f in files)
    audit = tmp_path / "out/audit"
    assert {p.name for p in audit.iterdir()} >= {"AllRunMetrics", "OutlierManifest", "SplitManifest", "SelectedVariableManifest", "RunWarnings", "RunMetadata", "PredeclaredExclusionAudit"}
    (part,) = [p for p in (audit / "OutlierManifest").iterdir() if p.suffix == ".csv"]
    assert part.read_bytes().startswith(b"\xef\xbb\xbftarget,outerSplitId,trainRatio,repeatId,nOuterPopulationSamples")
    manifest = {r.target: r for r in out["OutlierManifest"].collect()}
    assert manifest["EA"].nOuterPopulationSamples == N - 1 and manifest["EA"].nOriginalSamples == N
    with pytest.raises(ValueError, match="without a reason"):
        reports.run_files(spark, *paths, Config(**{**CFG.__dict__, "require_reason_for_missing": True}), str(tmp_path / "strict"), str(folder / "excluded.csv"))
    assert Config(algorithms=("PLS", "Ridge", "PLS")).algorithms == ("PLS", "Ridge")


def test_screen(spark, folder, tmp_path):
    cfg = Config(mccv_iterations=20, max_pls_components=3)
    out = reports.screen_files(spark, str(folder / "spectra.csv"), str(folder / "reference.csv"), cfg, str(tmp_path / "screen.xlsx"), str(tmp_path / "screen"))
    assert spark.read.option("header", True).csv(str(tmp_path / "screen/Manifest")).count() == 2 * N - 1
    s = {r.target: r for r in out["Summary"].collect()}
    assert s["EA"].nOriginalValid == N and s["EA"].nRetained + s["EA"].nExcluded == N and s["Analyte2"].nOriginalValid == N - 1
    assert len(workbook.cells((tmp_path / "screen.xlsx").read_bytes())) == 3
    errors = study.mccv_errors(*_wide(spark, folder), cfg)
    assert errors.count() == 20 * (N - max(8, round(0.78 * N)))


def test_study_screens_and_resumes_within_targets(spark, folder):
    spectra, ref = _wide(spark, folder)
    axis = [200 + 2.5 * j for j in range(P)]
    cfg = Config(**{**CFG.__dict__, "algorithms": ("PLS", "Ridge", "Torch1DCNN"), "screen_calibration": True, "mccv_iterations": 20, "max_pls_components": 3})
    whole = study.run_study(spectra, ref, axis, cfg, tasks_per_group=2).drop("elapsed_sec").collect()
    assert len(whole) == 6 and {r.split_id for r in whole} == {1, 2}
    assert all(r.n_calibration + len(r.screened_out) + r.n_prediction == r.n_samples == N for r in whole)
    keys = ("target", "outer_split_id", "preprocess", "y_transform", "algorithm")
    done = spark.createDataFrame([tuple(r[k] for k in keys) for r in whole if r.preprocess == "RAW"], list(keys))
    rest = study.run_study(spectra, ref, axis, cfg, done=done, tasks_per_group=2).drop("elapsed_sec").collect()
    assert sorted(map(repr, rest)) == sorted(repr(r) for r in whole if r.preprocess != "RAW")
    plan = study.run_study(spectra, ref, axis, cfg)._jdf.queryExecution().executedPlan().toString()
    assert all("x#" not in line for line in plan.splitlines() if "Exchange hashpartitioning" in line)
    # beyond a broadcast's size groups are dealt to tasks again, in a number that isn't coalesced
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    large = study.run_study(spectra, ref, axis, cfg, tasks_per_group=2).drop("elapsed_sec")
    try:
        assert large._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") > plan.count("REPARTITION_BY_NUM") > 0
        assert sorted(map(repr, large.collect())) == sorted(map(repr, whole))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    out = study.summarise(study.run_study(spectra, ref, axis, cfg), cfg, axis)
    o = out["OutlierManifest"].first()
    assert o.nCalibrationRaw == o.nCalibrationUsed + o.nCalibrationExcluded
    v = out["SelectedVariableManifest"].collect()
    assert {r.featurePath for r in v} == {"ranked8"} and all(len(r["selectedRamanShifts_cm-1"].split(",")) == 8 for r in v)


def test_specification_and_folder_reports(spark, tmp_path):
    (tmp_path / "spec.json").write_text('{"splits": {"ratios": [0.75, 0.8]},\n "algorithms": ["PLS"]}')
    assert tables.specification(spark, str(tmp_path / "spec.json")).first().splits.ratios == [0.75, 0.8]
    (tmp_path / "folder" / "deep").mkdir(parents=True)
    (tmp_path / "folder" / "a.txt").write_text("plain")
    (tmp_path / "folder" / "deep" / "b.txt").write_text("\u6587\u5b57" + "x" * 50, encoding="utf-8")
    got = {r.path.rsplit("/", 1)[1]: (r.too_large, r.forbidden_text) for r in validate.file_report(tables.files(spark, str(tmp_path / "folder")), max_bytes=40).collect()}
    assert got == {"a.txt": (False, False), "b.txt": (True, True)}
    (tmp_path / "release.json").write_text('{"ratios": [0.75], "repeats": 2, "recipes": ["RAW", "SNV"], "title": "x"}')
    (tmp_path / "manifest.csv").write_text("abbreviation,sample,status\nEA,S1,included\nEA,S2,excluded\nEB,S1,included\nEB,S2,included\n")
    checks = reports.validate_files(spark, str(tmp_path / "folder"), str(tmp_path / "release.json"), CFG, str(tmp_path / "manifest.csv"), {"EA": 1, "EB": 1}, 2, max_bytes=40)
    assert {r.check_name: r.passed for r in checks.collect()} == {"files_too_large": False, "files_with_forbidden_text": False, "specification_ratios": True, "specification_repeats": False, "specification_recipes": True, "samples EA": True, "samples EB": False}
    m = spark.createDataFrame([("EA", "included")] * 3 + [("EA", "excluded")] + [("EB", "included")] * 4, "abbreviation string, status string")
    assert {r.abbreviation: r.passed for r in validate.published_counts(m, {"EA": 3, "EB": 3, "EC": 0}, 4).collect()} == {"EA": True, "EB": False, "EC": False}


def test_fixed_schema_keeps_kinds(spark):
    kinds = dict(ranking.fixed_schema(spark.range(1).selectExpr("'a' as target"), ranking.METRIC_COLUMNS).dtypes)
    assert kinds["Rp2"] == "double" and kinds["splitId"] == "bigint" and kinds["modelName"] == "string"


def test_orders(spark):
    t = spark.createDataFrame([("b", 0), ("a", 1)], "target string, ordinal int")
    d = spark.createDataFrame([("a", "m", "Prediction", "s2"), ("z", "m", "Prediction", "s"), ("a", "m", "Prediction", "s1"), ("b", "n", "Calibration", "s")], "target string, modelName string, setType string, sampleName string")
    assert [(r.target, r.sampleName) for r in ranking.prediction_order(d, t).collect()] == [("b", "s"), ("a", "s1"), ("a", "s2"), ("z", "s")]


def _wide(spark, folder):
    spectra, _ = tables.spectra(tables.read_wide(spark, str(folder / "spectra.csv")))
    ref = tables.reference(tables.read_wide(spark, str(folder / "reference.csv"))).where("target = 'EA'")
    return spectra.select("sample_id", "x"), ref.select("target", "sample_id", "value")


def test_workbook_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a<b", 1.5, None), ("c", 2.0, 7)], "x string, y double, z int")
    names = workbook.write_sheets(str(tmp_path / "w.xlsx"), {"a/b": df}, max_rows=1)
    assert names == ["a_b_1", "a_b_2"]
    assert [tuple(r) for r in workbook.read_sheet(spark, str(tmp_path / "w.xlsx")).collect()] == [("a<b", "1.5", None)]

"""Populations, splits, metrics, ranking and screens on small literal tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayline.config import Config, stable_seed
from assayline.functions.columns import seed_column
from assayline.operators import metrics, population, ranking, response, robustness, screening, selection, splits

NAN, INF = float("nan"), float("inf")


def test_seed_column(spark):
    got = spark.range(1).select(seed_column(F.lit("2026"), F.lit("outer_split"), F.lit("7"))).first()[0]
    assert got == stable_seed(2026, "outer_split", 7)


def test_metrics(spark):
    rows = [("a", "cal", 1.0, 1.1), ("a", "cal", 2.0, 1.8), ("a", "cal", 4.0, NAN), ("a", "pred", 1.0, 1.5), ("a", "pred", 3.0, 2.5), ("b", "cal", 1.0, 1.0), ("b", "pred", 2.0, INF)]
    got = {r.k: r for r in metrics.evaluation(spark.createDataFrame(rows, "k string, role string, actual double, predicted double"), ["k"]).collect()}
    assert got["a"].RMSEP == pytest.approx(0.5) and got["a"].Rp2 == pytest.approx(0.75) and got["a"].RPD == pytest.approx(1 / np.sqrt(1 - 0.75))
    assert got["a"].Rc2 == pytest.approx(1 - (0.01 + 0.04) / 0.5)
    assert got["b"].Rc2 is None and got["b"].RMSEP == INF


def test_complete_rmse(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, NAN)], "y double, p double")
    assert df.agg(metrics.complete_rmse(F.col("y"), F.col("p"))).first()[0] == INF


def test_one_standard_error(spark):
    errors = [(0, 1.0), (0, 1.2), (1, 0.9), (1, 1.1), (2, NAN), (2, NAN), (3, 0.95)]
    c = metrics.candidate_statistics(spark.createDataFrame(errors, "idx int, error double"), ["idx"])
    stats = {r.idx: (r["mean"], r.se) for r in c.collect()}
    assert stats[2] == (INF, INF) and stats[3] == (0.95, 0.0) and stats[0][1] == pytest.approx(0.1)
    c = c.withColumn("k", F.lit(1)).withColumn("complexity", F.col("idx"))
    assert metrics.one_standard_error(c, ["k"]).first().idx == 3
    assert metrics.one_standard_error(c.where("idx < 3"), ["k"]).first().idx == 0
    assert metrics.one_standard_error(c.where("idx < 3"), ["k"], False).first().idx == 1


def test_ranking_puts_nan_last(spark):
    rows = [("t", 1, NAN, 1.0), ("t", 2, 0.5, 2.0), ("t", 3, 0.5, 1.0), ("t", 4, 0.5, 1.0)]
    df = spark.createDataFrame(rows, "target string, splitId int, Rp2 double, RMSEP double")
    assert ranking.best_by(df, ["target"]).first().splitId == 3
    assert [r.splitId for r in ranking.top_n(df, 9).collect()] == [3, 4, 2, 1]


def test_population(spark):
    ref = spark.createDataFrame([("A", "s1", 1.0), ("A", "s2", NAN), ("A", "s3", 2.0), ("B", "s1", 1.0), ("B", "s3", None)], "target string, sample_id string, value double")
    man = spark.createDataFrame([("A", "s1", "first", 0), ("A", "s1", " last ", 1), ("*", "s3", "", 2), ("A", "zz", "x", 3)], "target string, sample_id string, reason string, seq int")
    got = {(r.target, r.sample_id): (r.excluded, r.reasons) for r in population.resolve_population(ref, man).collect()}
    assert got["A", "s1"] == (True, "last") and got["B", "s1"] == (False, "")
    assert got["A", "s3"] == (True, population.DEFAULT_REASON) and got["A", "s2"] == (True, "MissingReferenceValue")
    assert got["B", "s3"] == (True, f"MissingReferenceValue; {population.DEFAULT_REASON}")


def test_align_needs_eight(spark):
    ids = spark.createDataFrame([(f"s{i}",) for i in range(7)], "sample_id string")
    with pytest.raises(ValueError):
        population.align(ids, ids.select(F.lit("t").alias("target"), "sample_id", F.lit(1.0).alias("value")))


@pytest.mark.parametrize("n", [12, 25, 80])
def test_splits(spark, n):
    y = np.random.default_rng(n).normal(size=n)
    ref = spark.createDataFrame([("t", f"s{i}", float(v)) for i, v in enumerate(y)], "target string, sample_id string, value double")
    cfg = Config(ratios=(0.75, 0.85), repeats=2)
    rows = splits.outer_splits(ref, cfg).collect()
    assert len(rows) == 4 * n
    for s in range(1, 5):
        own = [r for r in rows if r.outer_split_id == s]
        assert sum(r.role == "cal" for r in own) == min(max(2, round(own[0].train_ratio * n)), n - 1)
    again = splits.outer_splits(ref.repartition(3), cfg).collect()
    assert {(r.outer_split_id, r.sample_id, r.role) for r in rows} == {(r.outer_split_id, r.sample_id, r.role) for r in again}


def test_factorial(spark):
    cfg = Config()
    tasks = splits.factorial(spark, cfg)
    assert tasks.count() == cfg.evaluations == 100_800
    assert tasks.where("algorithm = 'PLS'").select("split_id").distinct().count() == 3360
    with pytest.raises(ValueError):
        Config(repeats=9).validate()


def test_folds():
    got = splits.folds(13, 5, 2, 1)
    assert len(got) == 10 and sorted(np.concatenate([t for _, t in got[:5]]).tolist()) == list(range(13))
    assert [len(t) for _, t in got[:5]] == [3, 3, 3, 2, 2]


def test_screen_guard(spark):
    def run(values, ratio=0.18):
        df = spark.createDataFrame([("t", f"s{i}", float(v)) for i, v in enumerate(values)], "target string, sample_id string, abs_error double")
        return screening.screen(screening.mean_errors(df), ratio).collect()

    rng = np.random.default_rng(0).uniform(0.9, 1.1, 66).tolist()
    assert sum(not r.keep for r in run(rng + [9.0] * 14)) == 14
    assert all(r.keep for r in run(rng[:65] + [9.0] * 15))
    assert all(r.keep for r in run([1.0] * 12 + [9.0]))


def test_selection(spark):
    s = spark.createDataFrame([(0, 0.5), (1, 0.9), (2, 0.9), (3, NAN), (4, 0.1)], "pos int, score double")
    assert sorted(r.pos for r in selection.top_k(s, 2).collect()) == [1, 2]
    assert selection.contiguous_window(s.where("pos != 3"), 2).first()[:2] == (1, 2)


def test_response_round_trip(spark):
    df = spark.createDataFrame([(0.0,), (3.5,)], "y double")
    for t in ("raw", "log1p", "sqrt"):
        back = df.select(response.inverse(response.forward(F.col("y"), t), t).alias("b")).collect()
        assert [r.b for r in back] == pytest.approx([0.0, 3.5])
    assert df.select(response.inverse(F.lit(-2.0), "sqrt")).first()[0] == 0


def test_robustness(spark):
    rows = [("t", "m", 0.9, 0.8, True, False), ("t", "m", 0.9, 0.7, False, False), ("t", "n", 0.9, -20.0, False, True)]
    parts = robustness.components(spark.createDataFrame(rows, "target string, model string, Rc2 double, Rp2 double, criterion boolean, severe boolean"), ["target", "model"])
    got = {r.model: r for r in robustness.scored(parts, (0.25, 0.2, 0.2, 0.15, 0.15, 0.05)).collect()}
    assert got["m"].median_rp2 == pytest.approx(0.75) and got["m"].q10_rp2 == pytest.approx(0.71) and got["n"].reliability == 0
    wins = robustness.weight_sensitivity(parts, "target", ["model"], (20, 16, 16, 12, 12, 4), 50, 1).collect()
    assert sum(r.wins for r in wins) == 50 and wins[0].model == "m"


def test_neighbours_among_all_samples(spark):
    import numpy as np

    from assayline.plans import catalogue, views

    sf = "/root/testdata/sf0.01"
    rows = views.signals(spark, sf).join(views.reference(spark, sf).where("target = 'T1'"), "sample_id").orderBy("sample_id").collect()
    pred, cal = ([r for r in rows if r.role == role] for role in ("pred", "cal"))
    d = np.linalg.norm(np.array([r.x for r in pred])[:, None] - np.array([r.x for r in cal])[None], axis=2)
    got = {r.sample_id: r for r in catalogue.QUERIES["knn_predict_all"](spark, sf).collect()}
    assert len(got) == len(pred)
    for i, r in enumerate(pred):
        near = np.argsort(d[i], kind="stable")[:5]
        w = 1 / np.maximum(d[i, near], 1e-12)
        assert got[r.sample_id].neighbours == 5
        assert abs(got[r.sample_id].predicted - (w * [cal[j].value for j in near]).sum() / w.sum()) < 1e-5
    rbf = {(r.sample_id, r.other): r.rbf for r in catalogue.QUERIES["pairwise_rbf_all"](spark, sf).collect()}
    assert len(rbf) == d.size
    assert max(abs(rbf[p.sample_id, c.sample_id] - np.exp(-0.01 * d[i, j] ** 2)) for i, p in enumerate(pred) for j, c in enumerate(cal)) < 1e-5

"""Operators whose groups may be of any size: ranks, neighbours, cross-products, quantiles, draws."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assayline.operators import farthest, moments, monte_carlo, neighbours, robustness
from assayline.operators.kernels.linear import pls_path, ridge_path
from assayline.operators.order import ranked
from assayline.operators.quantiles import quantiles
from assayline.plans import progress
from assayline.sources import digests

NAN, INF = float("nan"), float("inf")


def test_ranks_of_one_large_group(spark):
    rng = np.random.default_rng(1)
    rows = [("hot", int(v), i) for i, v in enumerate(rng.integers(0, 50, 3000))] + [("small", 5, 1), (None, 2, 7), (None, None, 8)]
    df = spark.createDataFrame(rows, "k string, v int, id int")
    got = ranked(df.repartition(7), ["k"], ["v", "id"])
    out = got.collect()
    hot = sorted((r["rank"], r.v, r.id) for r in out if r.k == "hot")
    assert [h[0] for h in hot] == list(range(3000)) and [(v, i) for _, v, i in hot] == sorted((v, i) for k, v, i in rows if k == "hot")
    assert {(r.id, r["rank"], r.n) for r in out if r.k is None} == {(8, 0, 2), (7, 1, 2)} and {r.n for r in out if r.k == "hot"} == {3000}
    # the only group lies over several tasks
    one = ranked(df.where("k = 'hot'"), ["k"], ["v", "id"])
    assert one.select(F.spark_partition_id()).distinct().count() > 1
    assert sorted(r["rank"] for r in ranked(df, [], [F.desc("v"), "id"]).collect()) == list(range(3003)) and ranked(df.limit(0), ["k"], ["v"]).count() == 0


def _nearest(left, right, k):
    usable = {i: v for i, v in right if v and all(x is not None and math.isfinite(x) for x in v)}
    out = {}
    for i, v in left:
        if v and all(x is not None and math.isfinite(x) for x in v):
            out[i] = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), j) for j, w in usable.items())[:k]
    return {i: v for i, v in out.items() if v}


@pytest.mark.parametrize("case", ["clusters", "ties", "few", "copies"])
def test_nearest_is_exact(spark, case):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8)) * 20
    x = centres[rng.integers(0, 6, 900)] + rng.normal(size=(900, 8))
    if case == "ties":
        x = np.round(x / 20) * 20
    if case == "copies":
        x[300:] = x[0]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    left, right = rows[:150], rows[150:] if case != "few" else rows[150:153]
    left = left + [(10_000, [NAN] * 8), (10_001, None), (10_002, []), (10_003, [None] * 8), (10_004, [100.0] * 8)]
    right = right + [(20_000, [INF] * 8), (20_001, None)]
    a, b = spark.createDataFrame(left, "sample_id bigint, x array<double>"), spark.createDataFrame(right, "other bigint, x2 array<double>")
    near, cost = neighbours.nearest(a, b, 4, pivots=12, piece=32, chunk=64)
    got = {}
    for r in near.collect():
        got.setdefault(r.sample_id, []).append((r["rank"], r.dist, r.other))
    want = _nearest(left, right, 4)
    assert set(got) == set(want)
    for i, found in got.items():
        assert [(round(d, 9), o) for _, d, o in sorted(found)] == [(round(d, 9), o) for d, o in want[i]]
    c = cost.first()
    assert c.pairs_of_all == 151 * (len(right) - 2)
    if case == "clusters":
        assert c.pairs_compared < 0.6 * c.pairs_of_all


def test_distances_and_neighbours_by_chunks(spark):
    """A key of many chunks gives every pair once; no task meets more than a chunk of either side."""
    rng = np.random.default_rng(6)
    left = [(i % 2, i, [float(v) for v in rng.normal(size=3)]) for i in range(90)] + [(None, 900, [0.0] * 3), (1, 901, None), (1, 902, [1.0, None, 2.0]), (7, 903, [0.0] * 3)]
    right = [(i % 2, 1000 + i, [float(v) for v in np.round(rng.normal(size=3), 1)], float(i)) for i in range(130)] + [(1, 2001, [1.0], 3.0), (None, 2002, [0.0] * 3, 1.0)]
    a, b = spark.createDataFrame(left, "g int, sample_id bigint, x array<double>"), spark.createDataFrame(right, "g int, other bigint, x2 array<double>, value double")
    got = neighbours.distances(a, b, ["g"], tile=16)
    assert "CartesianProduct" not in got._jdf.queryExecution().executedPlan().toString() and "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().executedPlan().toString()
    flat = lambda v, n: v is not None and len(v) == n and None not in v
    want = {(g, i, j): float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())) if flat(v, 3) and flat(w, 3) else None for g, i, v in left for h, j, w, _ in right if g is not None and g == h}
    out = got.collect()
    assert len(out) == len(want) and all(want[r.g, r.sample_id, r.other] is None if r.dist is None else abs(r.dist - want[r.g, r.sample_id, r.other]) < 1e-12 for r in out)
    every = neighbours.distances(a.drop("g"), b.drop("g", "value"), [], tile=16)
    assert every.columns == ["sample_id", "other", "dist"] and every.count() == len(left) * len(right) and every.distinct().count() == len(left) * len(right)
    near = {r.sample_id: r for r in neighbours.weighted_knn(a, b.where("size(x2) = 3"), ["g"], 4, tile=16).collect()}
    assert set(near) == {i for g, i, v in left if g in (0, 1) and flat(v, 3)}
    value = {j: v for _, j, _, v in right}
    for g, i, _ in (p for p in left if p[1] in near):
        best = sorted((d, j) for (h, s, j), d in want.items() if (h, s) == (g, i) and d is not None)[:4]
        w = [1 / max(d, 1e-12) for d, _ in best]
        assert near[i].neighbours == 4 and abs(near[i].predicted - sum(p * value[j] for p, (_, j) in zip(w, best, strict=True)) / sum(w)) < 1e-9


def test_all_pairs_shuffle_a_row_no_more_than_sixteen_times(spark):
    a = spark.range(700).select(F.col("id").alias("sample_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("x"))
    b = spark.range(900).select((F.col("id") + 5000).alias("other"), F.array(F.lit(0.0), F.col("id").cast("double")).alias("x2"))
    every = neighbours.distances(a, b, [], tile=8)
    assert every.count() == 700 * 900 and every.groupBy("sample_id", "other").count().count() == 700 * 900
    assert every.where("sample_id = 3 and other = 5004").first().dist == pytest.approx(np.sqrt(9 + 9))
    chunks = []
    real = type(a).groupBy

    def watched(df, *columns):
        if "_l" in columns:
            chunks.append(real(df, "_left").agg(F.count("*").alias("n")).collect())
        return real(df, *columns)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(a), "groupBy", watched)
        neighbours.distances(a, b, [], tile=8)
    assert {r["_left"]: r.n for r in chunks[0]} == {True: 700 * 16, False: 900 * 16}


def test_nearest_of_nothing(spark):
    a, b = spark.createDataFrame([(1, [1.0])], "sample_id bigint, x array<double>"), spark.createDataFrame([], "other bigint, x2 array<double>")
    assert neighbours.nearest(a, b, 3)[0].count() == 0
    assert neighbours.nearest(a.limit(0), b.unionByName(a.select(F.col("sample_id").alias("other"), F.col("x").alias("x2"))), 3)[0].count() == 0


def _rows(spark, n=240, p=6):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(n, p)) * [1, 5, 0.1, 1, 2, 1] + 1e6
    x[:, 5] = 7.0
    y = 3 * x[:, 0] - 2 * x[:, 2] + rng.normal(size=n) + 4e5
    df = spark.createDataFrame([("a" if i % 3 else None, i % 5, [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], "k string, fold int, x array<double>, y double")
    bad = spark.createDataFrame([("a", 1, [1.0] * 5, 1.0), ("a", 1, None, 1.0), ("a", 1, [NAN] * p, 1.0), ("a", 1, [1.0] * p, None)], df.schema)
    keep = {None: np.arange(n) % 3 == 0, "a": np.arange(n) % 3 != 0}
    return df.unionByName(bad), x, y, keep


def test_pls_from_cross_products(spark):
    df, x, y, keep = _rows(spark)
    for components in (1, 2, 4):
        got = moments.pls_scores(df, ["k"], 6, components).collect()
        for k, m in keep.items():
            beta = pls_path(x[m], y[m], components)[0][-1]
            mine = [r for r in sorted((r for r in got if r.k == k), key=lambda r: r.pos)]
            assert np.allclose([r.coef for r in mine], beta, rtol=1e-6, atol=1e-8)
            corr = [abs(np.corrcoef(x[m][:, j], y[m])[0, 1]) if j != 5 else 0.0 for j in range(6)]
            assert np.allclose([r["corr"] for r in mine], corr, atol=1e-8)
    assert moments.pls_scores(df.limit(0), ["k"], 6, 2).count() == 0


def test_ridge_from_fold_sums(spark):
    df, x, y, keep = _rows(spark)
    penalties = np.array([0.01, 1.0, 100.0])
    got = {(r.k, r.fold, r.idx): r.error for r in moments.ridge_folds(df, ["k"], "fold", 6, penalties).collect()}
    fold = np.arange(len(y)) % 5
    for k, m in keep.items():
        for f in range(5):
            tr, te = m & (fold != f), m & (fold == f)
            s = x[tr].std(0)
            s = np.where(s < 1e-12, 1, s)
            p = ridge_path((x[tr] - x[tr].mean(0)) / s, y[tr], (x[te] - x[tr].mean(0)) / s, penalties)
            for i in range(3):
                assert got[k, f, i] == pytest.approx(np.sqrt(((p[i] - y[te]) ** 2).mean()), rel=1e-6)
    chosen = spark.createDataFrame([("a", 1.0)], "k string, penalty double")
    coef = moments.ridge_coefficients(df, ["k"], 6, chosen).orderBy("pos").collect()
    m = keep["a"]
    s = np.where(x[m].std(0) < 1e-12, 1, x[m].std(0))
    want = ridge_path((x[m] - x[m].mean(0)) / s, y[m], (x[:3] - x[m].mean(0)) / s, np.array([1.0]))[0]
    assert np.allclose([coef[0].intercept + x[i] @ [r.coef for r in coef] for i in range(3)], want, rtol=1e-6)
    one = moments.ridge_folds(df.where("fold = 2"), ["k"], "fold", 6, penalties)
    assert {r.error for r in one.collect()} == {INF}


@settings(max_examples=6, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(-100, 100), st.sampled_from([0.0, 1.0, NAN, INF, -INF, 1e300, 5e-324])), max_size=40), st.integers(1, 3))
def test_quantiles_of_any_values(spark, values, passes):
    df = spark.createDataFrame([("k", v) for v in values], "k string, v double")
    got = quantiles(df, ["k"], "v", {"a": 0.0, "b": 0.5, "c": 0.9, "d": 1.0}, passes).collect()
    held = sorted((v for v in values if v is not None), key=lambda v: (math.isnan(v), v))
    assert len(got) == bool(held)
    for r in got:
        for name, p in (("a", 0.0), ("b", 0.5), ("c", 0.9), ("d", 1.0)):
            at = p * (len(held) - 1)
            lo, hi = held[math.floor(at)], held[math.ceil(at)]
            want = lo if lo == hi or at == math.floor(at) else (1 - (at - math.floor(at))) * lo + (at - math.floor(at)) * hi
            assert (math.isnan(want) and math.isnan(r[name])) or r[name] == pytest.approx(want)


def test_quantiles_of_large_skewed_groups(spark):
    df = spark.range(60_000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 5).cast("string"))).alias("k"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(F.exp(F.pmod(F.col("id") * 7919, F.lit(1000)) / 50.0)).alias("v"))
    got = quantiles(df, ["k"], "v", {"lo": 0.1, "mid": 0.5, "hi": 0.999}).toPandas().set_index("k").sort_index()
    want = df.groupBy("k").agg(F.percentile("v", F.lit(0.1)).alias("lo"), F.median("v").alias("mid"), F.percentile("v", F.lit(0.999)).alias("hi")).toPandas().set_index("k").sort_index()
    pd.testing.assert_frame_equal(got, want)
    whole = quantiles(df, [], "v", {"mid": 0.5}).first()
    assert whole.mid == df.agg(F.median("v")).first()[0]


def test_dirichlet_draws(spark):
    alpha = (20, 16, 16, 12, 12, 4)
    w = np.array([r.w for r in spark.range(4000).select(robustness.dirichlet_weights(F.col("id"), alpha, 7).alias("w")).collect()])
    assert np.allclose(w.sum(1), 1) and np.allclose(w.mean(0), np.array(alpha) / 80, atol=0.004)
    assert np.allclose(w.var(0), np.array(alpha) / 80 * (1 - np.array(alpha) / 80) / 81, rtol=0.15)
    again = spark.range(17, 18).select(robustness.dirichlet_weights(F.col("id"), alpha, 7).alias("w")).first().w
    assert np.allclose(again, w[17])
    with pytest.raises(ValueError):
        robustness.dirichlet_weights(F.lit(1), (1.5,), 7)


def _kennard_stone(ids, x, ratio):
    n = len(x)
    want = min(max(2, round(ratio * n)), n - 1)
    s = x.std(0)
    z = (x - x.mean(0)) / np.where(s < 1e-12, 1, s)
    d = np.round(np.sqrt(((z[:, None] - z[None]) ** 2).sum(-1)), 9)
    i, j = np.nonzero(d == d.max())
    chosen = list(min((min(ids[a], ids[b]), max(ids[a], ids[b])) for a, b in zip(i, j, strict=True)))
    at = {v: k for k, v in enumerate(ids)}
    while len(chosen) < want:
        rest = [v for v in ids if v not in chosen]
        near = [d[at[v], [at[c] for c in chosen]].min() for v in rest]
        chosen.append(min(v for v, m in zip(rest, near, strict=True) if m == max(near)))
    return chosen[:want]


def test_kennard_stone_in_rounds(spark):
    rng = np.random.default_rng(9)
    groups = {"a": rng.normal(size=(90, 3)), "ties": np.round(rng.normal(size=(60, 3))), "pair": rng.normal(size=(2, 3)), "line": np.array([[0.0, 0, 1], [1, 0, 1], [10, 0, 1], [5, 0, 1]])}
    rows = [(k, 100 + i, [float(v) for v in r]) for k, x in groups.items() for i, r in enumerate(x)]
    rows += [("one", 1, [1.0, 2.0, 3.0]), ("a", 999, [NAN, 1.0, 1.0]), ("a", 998, None), ("a", 997, [1.0]), (None, 5, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "k string, sample_id bigint, x array<double>")
    got = {}
    for r in farthest.kennard_stone(df, ["k"], 3, 0.75, batch=7, tile=16).collect():
        got.setdefault(r.k, []).append((r.place, r.sample_id))
    assert {k: [s for _, s in sorted(v)] for k, v in got.items()} == {k: _kennard_stone([100 + i for i in range(len(x))], x, 0.75) for k, x in groups.items()}
    assert [s - 100 for _, s in sorted(got["line"])] == [0, 2, 3]


def test_kennard_stone_rounds_do_not_grow_with_the_rows(spark, monkeypatch):
    durable, written = farthest.durable, []
    monkeypatch.setattr(farthest, "durable", lambda df: written.append(1) or durable(df))
    rounds = []
    for n in (64, 256):
        x, ids = np.random.default_rng(n).normal(size=(n, 3)), list(range(n))
        x[n // 2 : n // 2 + 5] = x[0]  # copies
        df = spark.createDataFrame([("a", i, v.tolist()) for i, v in zip(ids, x, strict=True)], "k string, sample_id bigint, x array<double>")
        written.clear()
        got = [r.sample_id for r in farthest.kennard_stone(df, ["k"], 3, 0.75, batch=4, tile=8).orderBy("place").collect()]
        assert got == _kennard_stone(ids, x, 0.75)
        rounds.append(len(written))
    assert rounds[1] <= 1.5 * rounds[0]


def test_monte_carlo_by_sums(spark):
    rng = np.random.default_rng(4)
    n, p = 40, 5
    x = rng.normal(size=(n, p)) * [1, 2, 3, 1, 1] + 100
    x[:, 4] = 3.0
    y = x[:, 0] + 0.1 * rng.normal(size=n) + 50
    rows = [("t", i, [float(v) for v in r], float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    rows += [("t", 900, [NAN] * p, 1.0), ("t", 901, [1.0] * p, None), ("flat", 1, [1.0] * p, 2.0)] + [("few", i, [float(i)] * p, float(i)) for i in range(14)] + [(None, 3, [1.0] * p, 1.0)]
    df = spark.createDataFrame(rows, "target string, sample_id bigint, x array<double>, y double")
    got = {r.sample_id: r for r in monte_carlo.held_out_means(df, p, 12, 0.78, 7).collect()}
    assert all(r.target == "t" for r in got.values())
    import hashlib

    errors = {i: [] for i in range(n)}
    for it in range(12):
        u = sorted((int(hashlib.md5(f"7|mccv|t|{it}|{i}".encode()).hexdigest()[:13], 16), i) for i in range(n))
        tr, te = [i for _, i in u[:31]], [i for _, i in u[31:]]
        b, scale, mean, _ = pls_path(x[tr], y[tr], 1)
        for i, v in zip(te, scale(x[te]) @ b[0] + mean, strict=True):
            errors[i].append(abs(y[i] - v))
    assert {i: len(e) for i, e in errors.items() if e} == {i: r.n_predicted for i, r in got.items()}
    assert all(got[i].mean_error == pytest.approx(np.mean(e), rel=1e-8) for i, e in errors.items() if e)
    assert monte_carlo.held_out_means(df.limit(0), p, 12, 0.78, 7).count() == 0


def test_no_join_has_a_whole_target_in_one_task(spark, monkeypatch):
    durable, tasks = monte_carlo.durable, []

    def watched(df):
        out = durable(df)
        if "sample_id" in df.columns:
            tasks.append(out.select(F.input_file_name()).distinct().count())
        return out

    monkeypatch.setattr(monte_carlo, "durable", watched)
    monkeypatch.setattr(farthest, "_PART", 16)
    x = np.random.default_rng(5).normal(size=(300, 3))
    df = spark.createDataFrame([("a", i, v.tolist(), float(v[0])) for i, v in enumerate(x)], "target string, sample_id bigint, x array<double>, y double")
    plain = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    try:
        for k, v in plain.items():
            spark.conf.set(k, v)
        assert monte_carlo.held_out_means(df, 3, 6, 0.78, 7).count() > 0
    finally:
        for k in plain:
            spark.conf.unset(k)
    assert len(tasks) > 2 and min(tasks) > 1


def test_progress_is_observed(spark, tmp_path):
    df = spark.createDataFrame([("a", None, 2), ("a", "boom", 0), ("b", None, None), (None, "x", 1)], "target string, error string, w int")
    rows, watch = progress.observed(df, ["a", "b", "none"], F.col("error").isNotNull(), F.col("w"))
    rows.write.parquet(str(tmp_path / "out"))
    got = {r.target: tuple(r)[1:] for r in progress.figures(spark, watch, ["a", "b", "none"]).collect()}
    assert got == {"a": (2, 1, 2), "b": (1, 0, 0), "none": (0, 0, 0)}
    assert progress.figures(spark, progress.observed(df, [], F.lit(True), F.lit(1))[1], []).count() == 0


def test_digests_tell_changes(spark, tmp_path):
    def digest(rows, schema="a string, b string"):
        return tuple(digests.table_digest(spark.createDataFrame(rows, schema)).first())

    base = digest([("1", "2"), ("3", None)])
    assert base == digest([("3", None), ("1", "2")]) and base[0] == 2 and len(base[1]) == 64
    others = [[("2", "1"), ("3", None)], [("1", None), ("3", "2")], [("1", "2"), ("3", "")], [("1", "2"), ("3", None), ("3", None)], [("1;b=1:2", None), ("3", None)], []]
    assert len({base, *map(digest, others)}) == 7 and digest([])[1] == "0" * 64
    assert digest([(1, [1.0, 2.0])], "a int, b array<double>") != digest([(1, [2.0, 1.0])], "a int, b array<double>")
    import hashlib

    line = "a=1:1;b=1:2;"
    assert digest([("1", "2")])[1] == hashlib.sha256(line.encode()).hexdigest()
    assert int(digest([("1", "2")] * 5)[1], 16) == 5 * int(hashlib.sha256(line.encode()).hexdigest(), 16) % 2**256
    (tmp_path / "x").mkdir()
    (tmp_path / "x/f").write_bytes(b"abc")
    (row,) = digests.file_digests(spark, str(tmp_path / "x")).collect()
    assert (row.length, row.sha256) == (3, hashlib.sha256(b"abc").hexdigest())

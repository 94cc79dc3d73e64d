"""Registered queries of the calibration engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayline.config import RECIPES, Config
from assayline.functions.columns import finite, half_even, or_null, seed_column
from assayline.operators import farthest, metrics, moments, monte_carlo, neighbours, population, pretreat, ranking, response, robustness, screening, selection, splits
from assayline.operators.sql_forms import recipe_sql
from assayline.plans import closed_forms, progress, study, views
from assayline.plans.views import AXIS, CHANNELS, METRICS_SQL, PREDICTIONS_SQL, REFERENCE_SQL, SIGNALS_SQL
from assayline.sources.digests import table_digest, table_digest_sql
from assayline.sources.shared import durable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
CONFIG = Config()
METRICS = ("Rc2", "Rp2", "RMSEC", "RMSEP", "MAE", "RPD")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(*names: str, digits: int = 6) -> list[Column]:
    """Rounded for comparison, without negative zeros; infinities and NaN become null."""
    return [(F.round(or_null(F.col(n)), digits) + F.lit(0.0)).alias(n) for n in names]


def _r(*names: str, digits: int = 6) -> str:
    return ", ".join(f'CASE WHEN isfinite("{n}") THEN round("{n}", {digits}) + 0.0 END AS "{n}"' for n in names)


def _metrics(spark, sf_dir) -> DataFrame:
    got = metrics.evaluation(views.predictions(spark, sf_dir), ["target", "modelName", "repeatId"])
    return metrics.with_criterion(got, CONFIG.rp2_min, CONFIG.max_r2_gap, CONFIG.severe_rp2)


# --- pretreatments -------------------------------------------------------------------------------
def _pretreatment(recipe: str, digits: int = 6):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = views.long(pretreat.pretreat(views.signals(spark, sf_dir), recipe, AXIS, CHANNELS))
        return out.select("sample_id", "role", F.col("pos").cast("bigint").alias("pos"), *rounded("v", digits=digits))

    return run


for _recipe in RECIPES:
    _name = f"pre_{_recipe.lower().replace('-', '_')}"
    QUERIES[_name] = _pretreatment(_recipe)
    ORACLE_SQL[_name] = recipe_sql(_recipe, SIGNALS_SQL, AXIS, 6)


# --- populations ---------------------------------------------------------------------------------
@query("""
SELECT e.vec_id AS sample_id, l.quality::DOUBLE AS value, len(e.embedding)::BIGINT AS channels FROM embeddings e JOIN labels l ON e.vec_id = l.doc_id
""")
def align_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = views.table(spark, sf_dir, "labels").select(F.lit("quality").alias("target"), F.col("doc_id").alias("sample_id"), F.col("quality").cast("double").alias("value"))
    out = population.align(views.signals(spark, sf_dir), ref)
    return out.select("sample_id", "value", F.size("x").cast("bigint").alias("channels"))


_POPULATION = """
WITH ref AS (SELECT lang AS target, doc_id::VARCHAR AS sample_id, CASE WHEN n_chars % 97 = 0 THEN NULL ELSE n_chars::DOUBLE END AS value FROM documents),
man AS (SELECT CASE WHEN doc_id % 5 = 0 THEN '*' ELSE 'en' END AS target, doc_id::VARCHAR AS sample_id, CASE WHEN quality = 0 THEN 'low quality' ELSE '' END AS reason FROM labels WHERE toxic = 1),
dec AS (SELECT r.target, r.sample_id, max(CASE WHEN trim(reason) = '' THEN 'PredeclaredIndependentQCExclusion' ELSE trim(reason) END) AS reason FROM ref r JOIN man m ON r.sample_id = m.sample_id AND (m.target = r.target OR m.target = '*') GROUP BY ALL),
pop AS (SELECT r.target, r.sample_id, r.value, (r.value IS NULL OR dec.reason IS NOT NULL) AS excluded, concat_ws('; ', CASE WHEN r.value IS NULL THEN 'MissingReferenceValue' END, dec.reason) AS reasons FROM ref r LEFT JOIN dec ON r.target = dec.target AND r.sample_id = dec.sample_id)
"""


def _population(spark, sf_dir) -> DataFrame:
    docs, labels = views.table(spark, sf_dir, "documents"), views.table(spark, sf_dir, "labels")
    ref = docs.select(F.col("lang").alias("target"), F.col("doc_id").cast("string").alias("sample_id"), F.when(F.col("n_chars") % 97 != 0, F.col("n_chars").cast("double")).alias("value"))
    man = labels.where("toxic = 1").select(
        F.when(F.col("doc_id") % 5 == 0, "*").otherwise("en").alias("target"), F.col("doc_id").cast("string").alias("sample_id"), F.when(F.col("quality") == 0, "low quality").otherwise("").alias("reason"), F.col("doc_id").alias("seq")
    )
    return population.resolve_population(ref, man)


@query(_POPULATION + "SELECT target, sample_id, value, excluded, reasons FROM pop")
def population_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _population(spark, sf_dir)


@query(_POPULATION + "SELECT target, sample_id, value FROM pop WHERE NOT excluded")
def exclude_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return population.retained(_population(spark, sf_dir))


@query(_POPULATION + "SELECT target, count(*)::BIGINT AS n_original, count(*) FILTER (NOT excluded) AS n_retained, count(*) FILTER (excluded) AS n_excluded FROM pop GROUP BY target")
def population_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _population(spark, sf_dir).groupBy("target").agg(F.count("*").alias("n_original"), F.count_if(~F.col("excluded")).alias("n_retained"), F.count_if("excluded").alias("n_excluded"))


@query("SELECT event_id, value FROM events WHERE isfinite(value)")
def finite_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "events").where(finite(F.col("value"))).select("event_id", "value")


@query("""
SELECT event_type AS target, count(value) FILTER (isfinite(value)) AS n, CASE WHEN count(value) < 8 OR stddev_pop(value) < 1e-12 THEN 'not_screened' ELSE 'ok' END AS status FROM events GROUP BY event_type
""")
def screenable_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = views.table(spark, sf_dir, "events").select(F.col("event_type").alias("target"), "value")
    return population.screenable(ref).select("target", "n", "status")


@query(f"WITH {SIGNALS_SQL} SELECT pos::BIGINT AS pos FROM (SELECT sample_id, role, pos, CASE WHEN pos % 16 = 5 THEN 1.0 ELSE v END AS v FROM t0) WHERE role = 'cal' GROUP BY pos HAVING bool_and(isfinite(v)) AND stddev_pop(v) > 1e-12")
def bad_variable_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.long(views.signals(spark, sf_dir)).withColumn("v", F.when(F.col("pos") % 16 == 5, 1.0).otherwise(F.col("v")))
    return population.usable_variables(rows).select(F.col("pos").cast("bigint").alias("pos"))


# --- responses -----------------------------------------------------------------------------------
def _transform(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = views.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("value"))
        if name == "standard":
            s = rows.agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
            rows = rows.crossJoin(F.broadcast(s))  # one row
        z = response.forward(F.col("value"), name, F.col("m") if name == "standard" else None, F.col("s") if name == "standard" else None)
        rows = rows.withColumn("z", z)
        back = response.inverse(F.col("z"), name, F.col("m") if name == "standard" else None, F.col("s") if name == "standard" else None)
        return rows.select("o_orderkey", *rounded("z"), (F.round(back, 4) + F.lit(0.0)).alias("back"))

    return run


for _t, _fwd, _inv in (("raw", "value", "z"), ("log1p", "ln(1 + value)", "greatest(exp(z) - 1, 0)"), ("sqrt", "sqrt(value)", "greatest(z, 0) ** 2"), ("standard", "(value - avg(value) OVER ()) / stddev_pop(value) OVER ()", "z * stddev_pop(value) OVER () + avg(value) OVER ()")):
    QUERIES[f"resp_{_t}"] = _transform(_t)
    ORACLE_SQL[f"resp_{_t}"] = f"SELECT o_orderkey, round(z, 6) + 0.0 AS z, round({_inv}, 4) + 0.0 AS back FROM (SELECT o_orderkey, value, {_fwd} AS z FROM (SELECT o_orderkey, o_totalprice AS value FROM orders))"


@query("""
WITH v AS (SELECT o_orderstatus AS target, o_totalprice - 150000 AS value FROM orders), g AS (SELECT target, max(value) > min(value) AS varies, min(value) >= 0 AS positive FROM v GROUP BY target)
SELECT target, t AS transform, CASE t WHEN 'standard' THEN true WHEN 'raw' THEN varies ELSE varies AND positive END AS eligible FROM g, unnest(['raw', 'log1p', 'sqrt', 'standard']) AS u(t)
""")
def resp_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("target"), (F.col("o_totalprice") - 150000).alias("value"))
    return response.eligible(rows, ["target"])


@query("""
WITH h AS (SELECT o_orderkey, sha256('2026|outer_split|' || o_orderkey::VARCHAR) AS h FROM orders)
SELECT o_orderkey, ('0x' || h[7:8] || h[5:6] || h[3:4] || h[1:2])::BIGINT AS seed FROM h
""")
def stable_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "orders").select("o_orderkey", seed_column(F.lit("2026"), F.lit("outer_split"), F.col("o_orderkey").cast("string")).alias("seed"))


# --- splits and tasks ----------------------------------------------------------------------------
_BINS = f"""WITH {REFERENCE_SQL},
b0 AS (SELECT *, count(*) OVER (PARTITION BY target) AS n, row_number() OVER (PARTITION BY target ORDER BY value, sample_id) - 1 AS rank FROM ref),
b1 AS (SELECT *, least(5, greatest(2, n // 12)) AS bins FROM b0),
b AS (SELECT b1.*, k AS bin FROM b1 JOIN unnest(range(0, 5)) AS u(k) ON k < bins AND rank >= (k * n) // bins AND rank < ((k + 1) * n) // bins)
"""


@query(_BINS + "SELECT target, sample_id, rank::BIGINT AS rank, bin::BIGINT AS bin FROM b")
def strat_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.response_bins(views.reference(spark, sf_dir)).select("target", "sample_id", F.col("rank").cast("bigint").alias("rank"), F.col("bin").cast("bigint").alias("bin"))


_SPLITS = (
    _BINS
    + """, dims AS (SELECT (i * 10 + rep)::INT AS outer_split_id, ratio, rep::INT AS repeat_id, sha256('2026|outer_split|' || printf('%.6f', ratio) || '|' || rep) AS h FROM (VALUES (0, 0.75::DOUBLE), (1, 0.80::DOUBLE), (2, 0.85::DOUBLE)) AS r(i, ratio), unnest(range(1, 11)) AS u(rep)),
o AS (SELECT b.*, outer_split_id, ratio, repeat_id, sha256(('0x' || h[7:8] || h[5:6] || h[3:4] || h[1:2])::BIGINT::VARCHAR || '|' || sample_id) AS ord FROM b, dims),
p AS (SELECT *, row_number() OVER (PARTITION BY target, outer_split_id, bin ORDER BY ord, sample_id) AS own, count(*) OVER (PARTITION BY target, outer_split_id, bin) AS size FROM o),
q AS (SELECT *, row_number() OVER (PARTITION BY target, outer_split_id ORDER BY own <= greatest(1, round_even(ratio * size, 0)) DESC, ord, sample_id) AS place FROM p),
s AS (SELECT target, outer_split_id, ratio AS train_ratio, repeat_id, sample_id, value, CASE WHEN place <= least(greatest(2, round_even(ratio * n, 0)), n - 1) THEN 'cal' ELSE 'pred' END AS role FROM q)
"""
)


@query(_SPLITS + "SELECT target, outer_split_id, train_ratio, repeat_id, sample_id, role FROM s")
def outer_split_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.outer_splits(views.reference(spark, sf_dir), CONFIG)


@query(_SPLITS + "SELECT target, outer_split_id, count(*) FILTER (role = 'cal') >= 8 AND count(*) FILTER (role = 'pred') >= 5 AND stddev_pop(value) FILTER (role = 'pred') >= 1e-12 AS ok FROM s GROUP BY ALL")
def split_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = views.reference(spark, sf_dir)
    return splits.check_splits(splits.outer_splits(ref, CONFIG), ref)


@query(_SPLITS + """SELECT target, outer_split_id, train_ratio, repeat_id, count(*) FILTER (role = 'cal') AS "nCalibration", count(*) FILTER (role = 'pred') AS "nPrediction", string_agg(sample_id, ',' ORDER BY sample_id) FILTER (role = 'pred') AS "predictionSamples" FROM s GROUP BY ALL""")
def split_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = splits.outer_splits(views.reference(spark, sf_dir), CONFIG)
    names = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == "pred", F.col("sample_id")))), lambda x: x.cast("string")), ",")
    return s.groupBy("target", "outer_split_id", "train_ratio", "repeat_id").agg(F.count_if(F.col("role") == "cal").alias("nCalibration"), F.count_if(F.col("role") == "pred").alias("nPrediction"), names.alias("predictionSamples"))


_KENNARD = f"""WITH RECURSIVE {SIGNALS_SQL},
z AS (SELECT g, sample_id, list((v - m) / s ORDER BY pos) AS z FROM (SELECT label AS g, sample_id, pos, v, avg(v) OVER w AS m, CASE WHEN stddev_pop(v) OVER w < 1e-12 THEN 1 ELSE stddev_pop(v) OVER w END AS s FROM t0 JOIN embeddings ON vec_id = sample_id WINDOW w AS (PARTITION BY label, pos)) GROUP BY ALL),
d AS MATERIALIZED (SELECT a.g, a.sample_id AS a, b.sample_id AS b, round(list_distance(a.z, b.z), 9) AS d FROM z a JOIN z b ON a.g = b.g),
n AS (SELECT g, least(greatest(2, round_even(0.75::DOUBLE * count(*), 0)), count(*) - 1)::BIGINT AS want FROM z GROUP BY g HAVING count(*) >= 2),
p AS (SELECT g, a, b FROM d WHERE a < b QUALIFY row_number() OVER (PARTITION BY g ORDER BY d DESC, a, b) = 1),
k AS (
  SELECT g, 0::BIGINT AS place, a AS sample_id, [a] AS taken FROM p UNION ALL SELECT g, 1, b, [a, b] FROM p
  UNION ALL
  SELECT g, place + 1, s, list_append(taken, s) FROM (SELECT k.g, k.place, k.taken, (SELECT arg_min(a, struct_pack(m := -near, a := a)) FROM (SELECT d.a, min(d.d) AS near FROM d WHERE d.g = k.g AND list_contains(k.taken, d.b) AND NOT list_contains(k.taken, d.a) GROUP BY d.a)) AS s FROM k JOIN n USING (g) WHERE place >= 1 AND place + 1 < want))
SELECT k.g AS label, sample_id, place FROM k JOIN n USING (g) WHERE place < want
"""


@query(_KENNARD)
def kennard_stone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three quarters of each label's samples by greatest least distance, all labels at once."""
    rows = views.table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("sample_id"), F.col("embedding").alias("x"))
    return farthest.kennard_stone(rows, ["label"], CHANNELS, 0.75)


def _list_sql(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


@query(f"""WITH {REFERENCE_SQL},
g AS (SELECT target, max(value) > min(value) AS varies, min(value) >= 0 AS positive FROM ref GROUP BY target),
t AS (SELECT target, a, yi FROM g, unnest({_list_sql(CONFIG.algorithms)}) AS t(a), unnest(range(4)) AS y(yi) WHERE {_list_sql(CONFIG.transforms)}[yi + 1] = 'standard' OR varies AND ({_list_sql(CONFIG.transforms)}[yi + 1] = 'raw' OR positive))
SELECT target, a AS algorithm, {_list_sql(CONFIG.transforms)}[yi + 1] AS y_transform, {_list_sql(CONFIG.recipes)}[pi + 1] AS preprocess, [0.75::DOUBLE, 0.80::DOUBLE, 0.85::DOUBLE][ri + 1] AS train_ratio, rep::INT AS repeat_id, (((yi * 28 + pi) * 3 + ri) * 10 + rep)::BIGINT AS split_id
FROM t, unnest(range(28)) AS p(pi), unnest(range(3)) AS r(ri), unnest(range(1, 11)) AS k(rep)
""")
def factorial_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tasks of a study of each target: the factorial over the transforms that the target's values allow."""
    able = response.eligible(views.reference(spark, sf_dir), ["target"]).where("eligible").select("target", F.col("transform").alias("y_transform"))
    return splits.factorial(spark, CONFIG).join(able, "y_transform")


# --- selection -----------------------------------------------------------------------------------
_CORR = f"""WITH {SIGNALS_SQL}, {REFERENCE_SQL},
k AS (SELECT target, pos, CASE WHEN sqrt(var_pop(v) * count(*)) <= 1e-12 OR sqrt(var_pop(value) * count(*)) <= 1e-12 THEN 0 ELSE abs(corr(v, value)) END AS corr FROM t0 JOIN ref USING (sample_id) WHERE role = 'cal' GROUP BY ALL),
n AS (SELECT target, pos, corr, (corr - min(corr) OVER w) / (max(corr) OVER w - min(corr) OVER w) AS score FROM k WINDOW w AS (PARTITION BY target))
"""


def _scores(spark, sf_dir) -> DataFrame:
    rows = views.long(views.signals(spark, sf_dir)).join(views.reference(spark, sf_dir).withColumnRenamed("value", "y"), "sample_id")
    got = selection.correlations(rows, ["target"])
    return got.withColumn("score", metrics.normalised(F.col("corr"), W.partitionBy("target")))


@query(_CORR + f"SELECT target, pos::BIGINT AS pos, {_r('corr', 'score')} FROM n")
def feature_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select("target", F.col("pos").cast("bigint").alias("pos"), *rounded("corr", "score"))


_COMBINED = f"""WITH {SIGNALS_SQL}, {REFERENCE_SQL},
d AS (SELECT target, sample_id, pos, v, value, (v - avg(v) OVER w) / CASE WHEN stddev_samp(v) OVER w < 1e-12 THEN 1 ELSE stddev_samp(v) OVER w END AS x, (value - avg(value) OVER w) / stddev_samp(value) OVER w AS y FROM t0 JOIN ref USING (sample_id) WHERE role = 'cal' WINDOW w AS (PARTITION BY target, pos)),
w1 AS (SELECT target, pos, c / sqrt(sum(c * c) OVER (PARTITION BY target)) AS w1 FROM (SELECT target, pos, sum(x * y) AS c FROM d GROUP BY ALL)),
t1 AS (SELECT target, sample_id, sum(x * w1) AS t1, any_value(y) AS y FROM d JOIN w1 USING (target, pos) GROUP BY ALL),
n1 AS (SELECT target, sum(t1 * t1) AS tt, sum(t1 * y) / sum(t1 * t1) AS q1 FROM t1 GROUP BY ALL),
p1 AS (SELECT target, pos, sum(x * t1) / any_value(tt) AS p1 FROM d JOIN t1 USING (target, sample_id) JOIN n1 USING (target) GROUP BY ALL),
e AS (SELECT target, sample_id, pos, x - t1 * p1 AS x, d.y FROM d JOIN t1 USING (target, sample_id) JOIN p1 USING (target, pos)),
w2 AS (SELECT target, pos, c / sqrt(sum(c * c) OVER (PARTITION BY target)) AS w2 FROM (SELECT target, pos, sum(x * y) AS c FROM e GROUP BY ALL)),
n2 AS (SELECT target, sum(t2 * y) / sum(t2 * t2) AS q2 FROM (SELECT target, sample_id, sum(x * w2) AS t2, any_value(y) AS y FROM e JOIN w2 USING (target, pos) GROUP BY ALL) GROUP BY target),
b AS (SELECT target, pos, abs(w1 * q1 + (w2 - w1 * sum(p1 * w2) OVER (PARTITION BY target)) * q2) AS coef FROM w1 JOIN p1 USING (target, pos) JOIN w2 USING (target, pos) JOIN n1 USING (target) JOIN n2 USING (target)),
k AS (SELECT target, pos, coef, corr FROM b JOIN (SELECT target, pos, abs(corr(v, value)) AS corr FROM d GROUP BY ALL) USING (target, pos)),
n AS (SELECT target, pos, 0.7::DOUBLE * (coef - min(coef) OVER w) / (max(coef) OVER w - min(coef) OVER w) + 0.3::DOUBLE * (corr - min(corr) OVER w) / (max(corr) OVER w - min(corr) OVER w) AS score FROM k WINDOW w AS (PARTITION BY target))
"""


def _calibration(spark, sf_dir) -> DataFrame:
    """(target, sample_id, x, y) of the calibration rows."""
    return views.signals(spark, sf_dir).where("role = 'cal'").join(views.reference(spark, sf_dir), "sample_id").select("target", "sample_id", "x", F.col("value").alias("y"))


@query(_COMBINED + f"SELECT target, pos::BIGINT AS pos, {_r('score')} FROM n")
def feature_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients of a PLS model of two components and correlations, scaled and weighed together; both from one aggregate."""
    got = selection.combined_scores(moments.pls_scores(_calibration(spark, sf_dir), ["target"], CHANNELS, 2), ["target"])
    return got.select("target", F.col("pos").cast("bigint").alias("pos"), *rounded("score"))


_PENALTIES = (0.01, 0.1, 1.0, 10.0, 100.0, 1000.0)
_THREE = (3, 10, 20)
_RIDGE = f"""WITH {REFERENCE_SQL},
d AS (SELECT target, sample_id, (sample_id // 4) % 5 AS fold, value AS y, {", ".join(f"embedding[{c + 1}]::DOUBLE AS x{i}" for i, c in enumerate(_THREE, 1))} FROM embeddings JOIN ref ON vec_id = sample_id WHERE vec_id % 4 != 0),
f AS (SELECT target, k AS fold, avg(y) AS my, {", ".join(f"avg(x{i}) AS m{i}, CASE WHEN stddev_pop(x{i}) < 1e-12 THEN 1 ELSE stddev_pop(x{i}) END AS s{i}" for i in (1, 2, 3))},
  {", ".join(f"covar_pop(x{i}, x{j}) * count(*) AS c{i}{j}" for i in (1, 2, 3) for j in range(i, 4))}, {", ".join(f"covar_pop(x{i}, y) * count(*) AS b{i}" for i in (1, 2, 3))} FROM d, unnest(range(5)) AS u(k) WHERE d.fold != k GROUP BY ALL),
m AS (SELECT f.*, idx, penalty, {", ".join(f"c{i}{j} / s{i} / s{j}{' + penalty' if i == j else ''} AS a{i}{j}" for i in (1, 2, 3) for j in range(i, 4))} FROM f, (SELECT unnest(range({len(_PENALTIES)}))::INT AS idx, unnest({list(_PENALTIES)})::DOUBLE AS penalty)),
s AS (SELECT *, {closed_forms.solved({"u": ("(b1 / s1)", "(b2 / s2)", "(b3 / s3)")})} FROM m),
e AS (SELECT s.target, s.fold, idx, penalty, sqrt(avg((d.y - my - u1 * (x1 - m1) / s1 - u2 * (x2 - m2) / s2 - u3 * (x3 - m3) / s3) ** 2)) AS error FROM s JOIN d ON s.target = d.target AND s.fold = d.fold GROUP BY ALL),
k AS (SELECT target, idx, penalty, avg(error) AS mean, stddev_samp(error) / sqrt(count(*)) AS se FROM e GROUP BY ALL),
b AS (SELECT *, first_value(mean + se) OVER (PARTITION BY target ORDER BY mean, idx) AS bound FROM k)
"""


def _ridge_errors(spark, sf_dir) -> DataFrame:
    rows = _calibration(spark, sf_dir).withColumn("fold", F.floor(F.col("sample_id") / 4) % 5).withColumn("x", F.array(*[F.get("x", c) for c in _THREE]))
    return moments.ridge_folds(rows, ["target"], "fold", len(_THREE), _PENALTIES)


@query(_RIDGE + f"SELECT target, fold, idx, {_r('error')} FROM e")
def ridge_fold_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out errors of a ridge path over five folds and all penalties, from one aggregate of cross-products by fold."""
    return _ridge_errors(spark, sf_dir).select("target", "fold", "idx", *rounded("error"))


@query(_RIDGE + f"SELECT target, penalty, {_r('mean', 'se')} FROM b WHERE mean <= bound QUALIFY row_number() OVER (PARTITION BY target ORDER BY -penalty, mean, idx) = 1")
def ridge_one_se(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest penalty within one standard error of the best over the folds."""
    s = metrics.candidate_statistics(_ridge_errors(spark, sf_dir), ["target", "idx", "penalty"]).withColumn("complexity", -F.col("penalty"))
    return metrics.one_standard_error(s, ["target"]).select("target", "penalty", *rounded("mean", "se"))


@query(_CORR + "SELECT * FROM (SELECT target, pos::BIGINT AS pos, row_number() OVER (PARTITION BY target ORDER BY score DESC, pos DESC) AS rank FROM n) WHERE rank <= 16")
def feature_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.top_k(_scores(spark, sf_dir), 16, ["target"]).select("target", F.col("pos").cast("bigint").alias("pos"), F.col("rank").cast("bigint").alias("rank"))


@query(_CORR + """, f AS (SELECT target, pos, round(sum(score) OVER w, 12) AS total, count(*) OVER w AS size, last_value(pos) OVER w AS last FROM n WINDOW w AS (PARTITION BY target ORDER BY pos ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING))
SELECT target, pos::BIGINT AS first, last::BIGINT AS last, round(total, 6) + 0.0 AS total FROM f WHERE size = 16 QUALIFY row_number() OVER (PARTITION BY target ORDER BY total DESC, pos) = 1""")
def contiguous_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = selection.contiguous_window(_scores(spark, sf_dir), 16, ["target"])
    return out.select("target", F.col("first").cast("bigint").alias("first"), F.col("last").cast("bigint").alias("last"), *rounded("total"))


# --- metrics and ranking -------------------------------------------------------------------------
@query(f"""WITH {METRICS_SQL} SELECT target, "modelName", "repeatId", {_r(*METRICS)}, "nCalibration", "nPrediction", criterion, severe FROM c""")
def metrics_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).select("target", "modelName", "repeatId", *rounded(*METRICS), "nCalibration", "nPrediction", "criterion", "severe")


@query(f"""WITH {METRICS_SQL} SELECT target, "modelName", round(avg(criterion::INT), 6) + 0.0 AS share, count(*) FILTER (severe) AS severe FROM c GROUP BY ALL""")
def criterion_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).groupBy("target", "modelName").agg((F.round(F.avg(F.col("criterion").cast("double")), 6) + F.lit(0.0)).alias("share"), F.count_if("severe").alias("severe"))


_BEST = """ORDER BY "Rp2" DESC NULLS LAST, CASE WHEN isfinite("RMSEP") THEN "RMSEP" END ASC NULLS LAST, "repeatId" """


@query(f"""WITH {METRICS_SQL} SELECT target, "modelName", "repeatId", {_r(*METRICS)} FROM c QUALIFY row_number() OVER (PARTITION BY target, "modelName" {_BEST}) = 1""")
def best_by_algorithm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.best_by(_metrics(spark, sf_dir), ["target", "modelName"], "repeatId").select("target", "modelName", "repeatId", *rounded(*METRICS))


@query(f"""WITH {METRICS_SQL} SELECT target, "modelName", "repeatId", {_r(*METRICS)} FROM c QUALIFY row_number() OVER (PARTITION BY target {_BEST}, "modelName") = 1""")
def best_by_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _metrics(spark, sf_dir).withColumn("seq", F.struct("repeatId", "modelName"))
    return ranking.best_by(m, ["target"], "seq").select("target", "modelName", "repeatId", *rounded(*METRICS))


@query(f"""WITH {METRICS_SQL} SELECT target, "modelName", "repeatId", {_r(*METRICS)} FROM c {_BEST}, target, "modelName" LIMIT 50""")
def top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _metrics(spark, sf_dir).withColumn("seq", F.struct("repeatId", "target", "modelName"))
    return ranking.top_n(m, CONFIG.top_n, "seq").select("target", "modelName", "repeatId", *rounded(*METRICS))


@query(f"""WITH {PREDICTIONS_SQL} SELECT target, "modelName", "repeatId", sample, CASE role WHEN 'cal' THEN 'Calibration' ELSE 'Prediction' END AS "setType", round(actual, 4) + 0.0 AS actual, round(predicted, 4) + 0.0 AS predicted, round(predicted - actual, 4) + 0.0 AS error, round(abs(predicted - actual), 4) + 0.0 AS "absError" FROM pred""")
def prediction_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ranking.prediction_details(views.predictions(spark, sf_dir))
    return out.select("target", "modelName", "repeatId", "sample", "setType", *rounded("actual", "predicted", "error", "absError", digits=4))


@query(f"""WITH {PREDICTIONS_SQL}, e AS (SELECT target, "modelName", "repeatId", sqrt(avg((actual - predicted) ** 2)) AS error FROM pred GROUP BY ALL),
s AS (SELECT target, "modelName", right("modelName", 1)::INT AS idx, avg(error) AS mean, stddev_samp(error) / sqrt(count(*)) AS se FROM e GROUP BY ALL),
b AS (SELECT *, first_value(mean + se) OVER (PARTITION BY target ORDER BY mean, idx) AS bound FROM s)
SELECT target, "modelName", {_r('mean', 'se')} FROM b WHERE mean <= bound QUALIFY row_number() OVER (PARTITION BY target ORDER BY 10 - idx, mean, idx) = 1""")
def one_se_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.predictions(spark, sf_dir).groupBy("target", "modelName", "repeatId").agg(metrics.rmse(F.col("actual"), F.col("predicted")).alias("error"))
    s = metrics.candidate_statistics(e, ["target", "modelName"]).withColumn("idx", F.substring("modelName", 2, 1).cast("int")).withColumn("complexity", 10 - F.col("idx"))
    return metrics.one_standard_error(s, ["target"]).select("target", "modelName", *rounded("mean", "se"))


@query(f"""WITH {PREDICTIONS_SQL}, e AS (SELECT target, "modelName", sqrt(avg((actual - predicted) ** 2)) AS rmse FROM pred GROUP BY ALL) SELECT target, "modelName", {_r('rmse')}, round(greatest(rmse, 1e-12) ** -2 / sum(greatest(rmse, 1e-12) ** -2) OVER (PARTITION BY target), 6) + 0.0 AS weight FROM e""")
def stack_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.predictions(spark, sf_dir).groupBy("target", "modelName").agg(metrics.complete_rmse(F.col("actual"), F.col("predicted")).alias("rmse"))
    return metrics.inverse_square_weights(e, ["target"]).select("target", "modelName", *rounded("rmse", "weight"))


# --- robustness ----------------------------------------------------------------------------------
_CRS = f"""WITH {METRICS_SQL},
k AS (SELECT target, "modelName", greatest(0, least(1, coalesce(median("Rp2"), 0))) AS median_rp2, greatest(0, least(1, coalesce(quantile_cont("Rp2", 0.1), 0))) AS q10_rp2, avg(criterion::INT) AS criterion_share,
  greatest(0, least(1, coalesce(1 - median(abs("Rc2" - "Rp2")), 0))) AS agreement, greatest(0, least(1, coalesce(1 - stddev_samp("Rp2"), 0))) AS stability, 1 - avg(severe::INT) AS reliability FROM c GROUP BY ALL),
s AS (SELECT *, 0.25 * median_rp2 + 0.20 * q10_rp2 + 0.20 * criterion_share + 0.15 * agreement + 0.15 * stability + 0.05 * reliability AS crs FROM k)
"""


def _crs(spark, sf_dir) -> DataFrame:
    return robustness.scored(robustness.components(_metrics(spark, sf_dir), ["target", "modelName"]), CONFIG.crs_weights)


@query(_CRS + f"""SELECT target, "modelName", {_r(*robustness.COMPONENTS, 'crs')} FROM s""")
def crs_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _crs(spark, sf_dir).select("target", "modelName", *rounded(*robustness.COMPONENTS, "crs"))


@query(_CRS + """SELECT target, "modelName", row_number() OVER (PARTITION BY target ORDER BY round(crs, 9) DESC, "modelName") AS rank FROM s""")
def crs_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robustness.ranked(_crs(spark, sf_dir), "target", ["modelName"]).select("target", "modelName", F.col("rank").cast("bigint").alias("rank"))


_DRAWS = f"""{_CRS}, a AS (SELECT unnest(range(6))::INT AS c, unnest({[int(a) for a in CONFIG.crs_alpha]}) AS alpha),
u AS (SELECT d, c, sum(-ln((('0x' || substr(md5('{CONFIG.crs_seed}|' || d || '|' || c || '|' || i), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)) AS g FROM range({CONFIG.crs_draws}) AS r(d), a, unnest(range(1, 21)) AS q(i) WHERE i <= alpha GROUP BY ALL),
w AS (SELECT d, {", ".join(f"max(g) FILTER (c = {i}) / sum(g) AS w{i}" for i in range(6))} FROM u GROUP BY d),
best AS (SELECT target, "modelName" FROM s, w QUALIFY row_number() OVER (PARTITION BY target, d ORDER BY round({" + ".join(f"w{i} * {c}" for i, c in enumerate(robustness.COMPONENTS))}, 9) DESC, "modelName" DESC) = 1)
"""


@query(_DRAWS + f"""SELECT target, "modelName", count(*)::BIGINT AS wins, round(count(*) / {CONFIG.crs_draws}, 6) + 0.0 AS share FROM best GROUP BY ALL""")
def crs_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = robustness.components(_metrics(spark, sf_dir), ["target", "modelName"])
    return robustness.weight_sensitivity(parts, "target", ["modelName"], CONFIG.crs_alpha, CONFIG.crs_draws, CONFIG.crs_seed).select("target", "modelName", "wins", *rounded("share"))


# --- screening -----------------------------------------------------------------------------------
_MAD = """WITH e AS (SELECT event_type AS target, user_id AS sample_id, avg(abs(value)) AS mean_error, count(*) AS n_predicted FROM events WHERE isfinite(value) GROUP BY ALL),
m AS (SELECT target, median(mean_error) AS med, count(*) AS n FROM e GROUP BY target),
t AS (SELECT target, any_value(m.n) AS n, any_value(med) AS med, median(abs(mean_error - med)) AS mad FROM e JOIN m USING (target) GROUP BY target),
f AS (SELECT e.*, n, med + 3 * mad AS threshold, mean_error > med + 3 * mad AS candidate FROM e JOIN t USING (target)),
g AS (SELECT *, count(*) FILTER (candidate) OVER (PARTITION BY target) AS k FROM f),
r AS (SELECT *, n >= 15 AND k <= greatest(10, round_even(0.18 * n, 0)) AND n - k >= 8 AS applied FROM g)
"""


def _means(spark, sf_dir) -> DataFrame:
    return screening.mean_errors(views.table(spark, sf_dir, "events").select(F.col("event_type").alias("target"), F.col("user_id").alias("sample_id"), F.abs("value").alias("abs_error")))


@query(_MAD + f"SELECT target, n, {_r('med', 'mad')}, round(med + 3 * mad, 6) + 0.0 AS threshold FROM t")
def mad_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.thresholds(_means(spark, sf_dir)).select("target", "n", *rounded("med", "mad", "threshold"))


@query(_MAD + f"SELECT target, sample_id, n_predicted, {_r('mean_error', 'threshold')}, candidate, applied, NOT (candidate AND applied) AS keep FROM r")
def mad_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.screen(_means(spark, sf_dir)).select("target", "sample_id", "n_predicted", *rounded("mean_error", "threshold"), "candidate", "applied", "keep")


# --- closed-form models --------------------------------------------------------------------------
@query(f"""WITH {SIGNALS_SQL}, {REFERENCE_SQL},
n AS (SELECT sample_id, role, pos, (v - avg(v) OVER w) / CASE WHEN stddev_pop(v) OVER w < 1e-12 THEN 1 ELSE stddev_pop(v) OVER w END AS v FROM t0 WINDOW w AS (PARTITION BY sample_id)),
d AS (SELECT target, role, v, value FROM n JOIN ref USING (sample_id) WHERE pos = 3),
f AS (SELECT target, regr_slope(value, v) AS k, regr_intercept(value, v) AS o FROM d WHERE role = 'cal' GROUP BY target),
p AS (SELECT target, role, value AS actual, o + k * v AS predicted FROM d JOIN f USING (target)),
m AS (SELECT target, 1 - sum((actual - predicted) ** 2) FILTER (role = 'cal') / (var_pop(actual) FILTER (role = 'cal') * count(*) FILTER (role = 'cal')) AS "Rc2", 1 - sum((actual - predicted) ** 2) FILTER (role = 'pred') / (var_pop(actual) FILTER (role = 'pred') * count(*) FILTER (role = 'pred')) AS "Rp2",
  sqrt(avg((actual - predicted) ** 2) FILTER (role = 'cal')) AS "RMSEC", sqrt(avg((actual - predicted) ** 2) FILTER (role = 'pred')) AS "RMSEP", avg(abs(actual - predicted)) FILTER (role = 'pred') AS "MAE", stddev_pop(actual) FILTER (role = 'pred') / sqrt(avg((actual - predicted) ** 2) FILTER (role = 'pred')) AS "RPD" FROM p GROUP BY target)
SELECT target, {_r(*METRICS)} FROM m""")
def calibration_1var(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-variable calibration after SNV: the minimum slice of a study, end to end."""
    s = pretreat.pretreat(views.signals(spark, sf_dir), "SNV", AXIS, CHANNELS).select("sample_id", "role", F.get("x", 3).alias("v"))
    d = s.join(views.reference(spark, sf_dir), "sample_id")
    fit = d.where("role = 'cal'").groupBy("target").agg(F.regr_slope("value", "v").alias("k"), F.regr_intercept("value", "v").alias("o"))
    p = d.join(fit, "target").select("target", "role", F.col("value").alias("actual"), (F.col("o") + F.col("k") * F.col("v")).alias("predicted"))
    return metrics.evaluation(p, ["target"]).select("target", *rounded(*METRICS))


@query(f"""WITH {SIGNALS_SQL}, {REFERENCE_SQL},
c AS (SELECT target, pos, avg(v) AS mx, stddev_samp(v) AS sx, avg(value) AS my, stddev_samp(value) AS sy, sum((v - mx0) / sx0 * (value - my0) / sy0) AS w FROM
  (SELECT t0.*, ref.target, ref.value, avg(v) OVER u AS mx0, stddev_samp(v) OVER u AS sx0, avg(value) OVER u AS my0, stddev_samp(value) OVER u AS sy0 FROM t0 JOIN ref USING (sample_id) WHERE role = 'cal' WINDOW u AS (PARTITION BY target, pos)) GROUP BY ALL),
n AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY target)) AS u FROM c),
s AS (SELECT n.target, t0.sample_id, any_value(role) AS role, sum((v - mx) / sx * u) AS t, any_value(my) AS my, any_value(sy) AS sy, any_value(value) AS actual FROM n JOIN t0 USING (pos) JOIN ref ON ref.target = n.target AND ref.sample_id = t0.sample_id GROUP BY ALL),
q AS (SELECT target, sum(t * (actual - my) / sy) / sum(t * t) AS q FROM s WHERE role = 'cal' GROUP BY target)
SELECT target, sample_id, role, round(actual, 6) + 0.0 AS actual, round(my + sy * q * t, 6) + 0.0 AS predicted FROM s JOIN q USING (target)""")
def pls_1comp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-component PLS as aggregates: weights are covariances of the standardised channels with the response."""
    rows = views.long(views.signals(spark, sf_dir)).join(views.reference(spark, sf_dir), "sample_id")
    # sums give the covariance in one pass; ddof 1 throughout
    c = rows.where("role = 'cal'").groupBy("target", "pos").agg(F.avg("v").alias("mx"), F.stddev_samp("v").alias("sx"), F.avg("value").alias("my"), F.stddev_samp("value").alias("sy"), F.covar_samp("v", "value").alias("cov"))
    c = c.withColumn("w", F.col("cov") / F.col("sx") / F.col("sy"))
    c = c.withColumn("u", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("target"))))
    s = rows.join(c, ["target", "pos"]).groupBy("target", "sample_id", "role").agg(F.sum((F.col("v") - F.col("mx")) / F.col("sx") * F.col("u")).alias("t"), F.first("my").alias("my"), F.first("sy").alias("sy"), F.first("value").alias("actual"))
    q = s.where("role = 'cal'").groupBy("target").agg((F.sum(F.col("t") * (F.col("actual") - F.col("my")) / F.col("sy")) / F.sum(F.col("t") * F.col("t"))).alias("q"))
    return s.join(q, "target").select("target", "sample_id", "role", *rounded("actual"), (F.round(F.col("my") + F.col("sy") * F.col("q") * F.col("t"), 6) + F.lit(0.0)).alias("predicted"))


for _m in closed_forms.MODELS:
    QUERIES[f"fixed_{_m}"] = closed_forms.fixed(_m)
    ORACLE_SQL[f"fixed_{_m}"] = closed_forms.SQL[_m]


# --- validation ----------------------------------------------------------------------------------
@query(r"""
SELECT 'embeddings_channels' AS check_name, '64' AS expected, string_agg(DISTINCT len(embedding)::VARCHAR, ',') AS actual, string_agg(DISTINCT len(embedding)::VARCHAR, ',') = '64' AS passed FROM embeddings
UNION ALL SELECT 'embeddings_nulls', '0', (count(*) FILTER (embedding IS NULL))::VARCHAR, count(*) FILTER (embedding IS NULL) = 0 FROM embeddings
UNION ALL SELECT 'embeddings_unique', '0', (count(*) - count(DISTINCT vec_id))::VARCHAR, count(*) = count(DISTINCT vec_id) FROM embeddings
UNION ALL SELECT 'labels_values', '0', (count(*) FILTER (quality NOT IN (0, 1) OR toxic NOT IN (0, 1)))::VARCHAR, count(*) FILTER (quality NOT IN (0, 1) OR toxic NOT IN (0, 1)) = 0 FROM labels
UNION ALL SELECT 'labels_in_documents', '0', (SELECT count(*) FROM labels ANTI JOIN documents USING (doc_id))::VARCHAR, (SELECT count(*) FROM labels ANTI JOIN documents USING (doc_id)) = 0
UNION ALL SELECT 'evaluations', '806400', (count(DISTINCT lang) * 2 * 100800)::VARCHAR, count(DISTINCT lang) * 2 * 100800 = 806400 FROM documents
UNION ALL SELECT 'han_characters', '0', (count(*) FILTER (regexp_matches(text, '[\x{4e00}-\x{9fff}]')))::VARCHAR, count(*) FILTER (regexp_matches(text, '[\x{4e00}-\x{9fff}]')) = 0 FROM documents
""")
def validator_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assayline.plans.validate import check

    e, labels, docs = (views.table(spark, sf_dir, n) for n in ("embeddings", "labels", "documents"))
    bad = ~F.col("quality").isin(0, 1) | ~F.col("toxic").isin(0, 1)
    rows = [
        check(e.agg(F.array_join(F.sort_array(F.collect_set(F.size("embedding").cast("string"))), ",").alias("actual")), "embeddings_channels", "64"),
        check(e.agg(F.count_if(F.col("embedding").isNull()).alias("actual")), "embeddings_nulls", "0"),
        check(e.agg((F.count("*") - F.count_distinct("vec_id")).alias("actual")), "embeddings_unique", "0"),
        check(labels.agg(F.count_if(bad).alias("actual")), "labels_values", "0"),
        check(labels.join(docs.select("doc_id"), "doc_id", "left_anti").agg(F.count("*").alias("actual")), "labels_in_documents", "0"),
        check(docs.agg((F.count_distinct("lang") * 2 * CONFIG.evaluations).alias("actual")), "evaluations", "806400"),  # two responses a language
        check(docs.agg(F.count_if(F.col("text").rlike("[\\u4e00-\\u9fff]")).alias("actual")), "han_characters", "0"),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query(f"""WITH {METRICS_SQL} SELECT target, count(*)::BIGINT AS tasks, count(*) FILTER (severe) AS failures, count(*) FILTER (NOT criterion)::BIGINT AS warnings FROM c GROUP BY target""")
def observed_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks, severe failures and unmet criteria by target, observed while the metrics are written."""
    rows = _metrics(spark, sf_dir)
    targets = [r.target for r in views.predictions(spark, sf_dir).select("target").distinct().collect()]  # a study's analytes
    watched, watch = progress.observed(rows, targets, F.col("severe"), F.when(F.col("criterion"), 0).otherwise(1))
    durable(watched.select("target", "modelName", "repeatId", *METRICS))
    return progress.figures(spark, watch, targets)


@query(table_digest_sql("labels", [("doc_id", "doc_id::VARCHAR"), ("quality", "quality::VARCHAR"), ("toxic", "toxic::VARCHAR")]))
def digest_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_digest(views.table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


@query(table_digest_sql("orders", [("o_orderkey", "o_orderkey::VARCHAR"), ("o_custkey", "o_custkey::VARCHAR"), ("o_orderstatus", "o_orderstatus"), ("cents", "round(o_totalprice * 100)::BIGINT::VARCHAR"), ("day", "o_orderdate::DATE::VARCHAR"), ("o_orderpriority", "o_orderpriority")]))
def digest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices in cents and dates as days, which both engines write alike."""
    orders = views.table(spark, sf_dir, "orders")
    return table_digest(orders.select("o_orderkey", "o_custkey", "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"), F.to_date("o_orderdate").alias("day"), "o_orderpriority"))


@query("""SELECT CASE WHEN toxic = 1 THEN 'excluded' ELSE 'included' END AS status, quality, count(*) AS n FROM labels GROUP BY ALL""")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = views.table(spark, sf_dir, "labels")
    return labels.groupBy(F.when(F.col("toxic") == 1, "excluded").otherwise("included").alias("status"), "quality").agg(F.count("*").alias("n"))


# --- studies -------------------------------------------------------------------------------------
#: Each 25th of the samples is a target of its own, so that every row takes part in a small calibration.
GROUPS = 25


def _grouped_reference(spark, sf_dir) -> DataFrame:
    ref = views.reference(spark, sf_dir).where("target = 'T1'")
    return ref.withColumn("target", F.format_string("G%02d", F.col("sample_id") % GROUPS))


def _study(algorithms: tuple[str, ...], **settings):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        config = Config(**{"algorithms": algorithms, "recipes": ("SNV",), "transforms": ("raw",), "ratios": (0.75,), "repeats": 1, "feature_count": 32, "level": "fast", "inner_repeats": 1, "require_full_factorial": False} | settings)
        out = study.run_study(views.signals(spark, sf_dir).select("sample_id", "x"), _grouped_reference(spark, sf_dir), AXIS, config)
        return out.select("target", "outer_split_id", "preprocess", "y_transform", "algorithm", *rounded(*METRICS), "n_calibration", "n_prediction", "n_features", "error")

    return run


for _a in CONFIG.algorithms:
    QUERIES[f"kernel_{_a.lower().replace('-', '_')}"] = _study((_a,))
QUERIES["study_small"] = _study(("PLS", "Ridge", "PCR", "BayesianRidge"), recipes=("RAW", "SNV", "MSC-SG", "DE1-SNV"), transforms=("raw", "log1p", "standard"), repeats=2)


@query()
def mccv_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = views.signals(spark, sf_dir).select("sample_id", "x")
    return study.mccv_screen(signals, _grouped_reference(spark, sf_dir), CONFIG)["Summary"]


_MONTE_CARLO = f"""WITH {SIGNALS_SQL}, {REFERENCE_SQL},
o AS (SELECT target, sample_id, value, i, row_number() OVER (PARTITION BY target, i ORDER BY ('0x' || substr(md5('{CONFIG.random_state}|mccv|' || target || '|' || i || '|' || sample_id), 1, 13))::BIGINT, sample_id) AS place, count(*) OVER (PARTITION BY target, i) AS n FROM ref, unnest(range({CONFIG.mccv_iterations})) AS r(i)),
s AS (SELECT *, place <= greatest(8, round_even({CONFIG.mccv_calibration}::DOUBLE * n, 0)) AS cal FROM o),
y AS (SELECT target, i, avg(value) AS my, stddev_samp(value) AS sy FROM s WHERE cal GROUP BY ALL),
x AS (SELECT target, i, pos, avg(v) AS m, stddev_samp(v) AS sx, covar_samp(v, value) / stddev_samp(v) AS c FROM s JOIN t0 USING (sample_id) WHERE cal GROUP BY ALL),
w AS (SELECT *, c / sqrt(sum(c * c) OVER (PARTITION BY target, i)) AS w FROM x),
t AS (SELECT s.target, s.i, s.sample_id, any_value(value) AS value, any_value(cal) AS cal, sum((v - m) / sx * w) AS t FROM s JOIN t0 USING (sample_id) JOIN w ON w.target = s.target AND w.i = s.i AND w.pos = t0.pos GROUP BY ALL),
q AS (SELECT target, i, any_value(my) AS my, sum(t * (value - my)) / sum(t * t) AS q FROM t JOIN y USING (target, i) WHERE cal GROUP BY ALL),
e AS (SELECT target, sample_id, avg(abs(value - my - q * t)) AS mean_error, count(*) AS n_predicted FROM t JOIN q USING (target, i) WHERE NOT cal GROUP BY ALL),
m AS (SELECT target, median(mean_error) AS med, count(*) AS n FROM e GROUP BY target),
l AS (SELECT target, any_value(m.n) AS n, any_value(med) + 3 * median(abs(mean_error - med)) AS threshold FROM e JOIN m USING (target) GROUP BY target),
f AS (SELECT e.*, n, threshold, mean_error > threshold AS candidate, count(*) FILTER (mean_error > threshold) OVER (PARTITION BY target) AS k FROM e JOIN l USING (target))
"""


@query(_MONTE_CARLO + f"SELECT target, sample_id, n_predicted, {_r('mean_error', 'threshold')}, candidate, NOT (candidate AND n >= 15 AND k <= greatest(10, round_even(0.18 * n, 0)) AND n - k >= 8) AS keep FROM f")
def mccv_whole_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Monte-Carlo screen of both targets over all samples, with one-component models; see `mccv_screen` for tuned ones on groups."""
    rows = views.signals(spark, sf_dir).join(views.reference(spark, sf_dir), "sample_id").select("target", "sample_id", "x", F.col("value").alias("y"))
    means = durable(monte_carlo.held_out_means(rows, CHANNELS, CONFIG.mccv_iterations, CONFIG.mccv_calibration, CONFIG.random_state))
    return screening.screen(means, CONFIG.max_outlier_ratio).select("target", "sample_id", "n_predicted", *rounded("mean_error", "threshold"), "candidate", "keep")


_WEIGHTED_KNN = f"""WITH {SIGNALS_SQL}, {REFERENCE_SQL},
x AS (SELECT vec_id AS sample_id, vec_id % 25 AS g, vec_id % 4 = 0 AS pred, list_transform(embedding, lambda a: a::DOUBLE) AS e FROM embeddings),
d AS (SELECT a.sample_id, b.sample_id AS other, list_distance(a.e, b.e) AS dist FROM x a JOIN x b USING (g) WHERE a.pred AND NOT b.pred),
k AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY dist, other) AS rank FROM d)
"""


@query(_WEIGHTED_KNN + "SELECT k.sample_id, round(sum(value / greatest(dist, 1e-12)) / sum(1 / greatest(dist, 1e-12)), 6) + 0.0 AS predicted, count(*) AS neighbours FROM k JOIN ref ON ref.sample_id = other AND target = 'T1' WHERE rank <= 5 GROUP BY k.sample_id")
def knn_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = views.signals(spark, sf_dir).withColumn("g", F.col("sample_id") % GROUPS)
    ref = views.reference(spark, sf_dir).where("target = 'T1'").select("sample_id", "value")
    cal = x.where("role = 'cal'").join(ref, "sample_id").select("g", F.col("sample_id").alias("other"), F.col("x").alias("x2"), "value")
    return neighbours.weighted_knn(x.where("role = 'pred'").select("g", "sample_id", "x"), cal, ["g"], 5).select("sample_id", *rounded("predicted"), "neighbours")


@query(_WEIGHTED_KNN + "SELECT sample_id, other, round(exp(-0.01 * dist * dist), 6) + 0.0 AS rbf FROM d")
def pairwise_rbf(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = views.signals(spark, sf_dir).withColumn("g", F.col("sample_id") % GROUPS)
    cal = x.where("role = 'cal'").select("g", F.col("sample_id").alias("other"), F.col("x").alias("x2"))
    return neighbours.distances(x.where("role = 'pred'").select("g", "sample_id", "x"), cal, ["g"]).select("sample_id", "other", (F.round(F.exp(-0.01 * F.col("dist") * F.col("dist")), 6) + F.lit(0.0)).alias("rbf"))


def _both_roles(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    x = views.signals(spark, sf_dir)
    ref = views.reference(spark, sf_dir).where("target = 'T1'").select("sample_id", "value")
    cal = x.where("role = 'cal'").join(ref, "sample_id").select(F.col("sample_id").alias("other"), F.col("x").alias("x2"), "value")
    return x.where("role = 'pred'").select("sample_id", "x"), cal


_ALL_KNN = f"""WITH {REFERENCE_SQL},
x AS (SELECT vec_id AS sample_id, vec_id % 4 = 0 AS pred, list_transform(embedding, lambda a: a::DOUBLE) AS e FROM embeddings),
k AS (SELECT a.sample_id, b.sample_id AS other, list_distance(a.e, b.e) AS dist, row_number() OVER (PARTITION BY a.sample_id ORDER BY list_distance(a.e, b.e), b.sample_id) AS rank FROM x a JOIN x b ON a.pred AND NOT b.pred)
"""


@query(_ALL_KNN + "SELECT k.sample_id, round(sum(value / greatest(dist, 1e-12)) / sum(1 / greatest(dist, 1e-12)), 6) + 0.0 AS predicted, count(*) AS neighbours FROM k JOIN ref ON ref.sample_id = other AND target = 'T1' WHERE rank <= 5 GROUP BY k.sample_id")
def knn_predict_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """knn_predict without its groups: each prediction row's five nearest of all calibration rows, by a pivot join."""
    pred, cal = _both_roles(spark, sf_dir)
    near, _ = neighbours.nearest(pred, cal, 5)
    return neighbours.weighted_mean(near.join(cal.select("other", "value"), "other"), ["sample_id"]).select("sample_id", *rounded("predicted"), "neighbours")


@query(_ALL_KNN + "SELECT sample_id, other, rank, round(dist, 6) + 0.0 AS dist FROM k WHERE rank <= 10")
def knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten calibration rows nearest to each prediction row."""
    near, _ = neighbours.nearest(*_both_roles(spark, sf_dir), 10)
    return near.select("sample_id", "other", F.col("rank").cast("bigint").alias("rank"), *rounded("dist"))


@query()
def pairwise_rbf_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pairwise_rbf without its groups: the whole kernel matrix."""
    pred, cal = _both_roles(spark, sf_dir)
    return neighbours.distances(pred, cal.drop("value"), []).select("sample_id", "other", (F.round(F.exp(-0.01 * F.col("dist") * F.col("dist")), 6) + F.lit(0.0)).alias("rbf"))


__all__ = ["CONFIG", "ORACLE_SQL", "QUERIES", "half_even"]

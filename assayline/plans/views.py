"""Views that present the driver's tables as signals, references and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.functions.columns import doubles

CHANNELS = 64
AXIS = [200.0 + 2.5 * p + 0.01 * p * p for p in range(CHANNELS)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, role, x) of embeddings; every fourth sample is for prediction."""
    role = F.when(F.col("vec_id") % 4 == 0, "pred").otherwise("cal")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), role.alias("role"), doubles(F.col("embedding")).alias("x"))


def long(signals: DataFrame, *keep: str) -> DataFrame:
    return signals.select("sample_id", "role", *keep, F.posexplode("x").alias("pos", "v"))


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(target, sample_id, value) with two responses made of a few channels."""
    e = doubles(F.col("embedding"))
    t1 = F.lit(50.0) + 20.0 * F.get(e, 3) - 15.0 * F.get(e, 10) + F.col("label")
    t2 = F.lit(30.0) + 10.0 * F.get(e, 5) + 5.0 * F.get(e, 20)
    rows = F.array(F.struct(F.lit("T1").alias("target"), t1.alias("value")), F.struct(F.lit("T2").alias("target"), t2.alias("value")))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), F.inline(rows)).select("target", "sample_id", "value")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(target, modelName, repeatId, sample, role, actual, predicted) made of lineitem."""
    algorithm = F.col("l_suppkey") % 10
    noise = F.pmod(F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729 + F.col("l_partkey") * 31, F.lit(1000)) / F.lit(1000.0) - F.lit(0.5)
    # one algorithm fails badly, so that every branch of the criterion is met
    size = F.lit(0.2) + F.lit(0.2) * algorithm + F.when((algorithm == 9) & (F.col("l_partkey") % 10 == 0), F.lit(12.0)).otherwise(F.lit(0.0))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("target"), F.concat(F.lit("A"), algorithm.cast("string")).alias("modelName"), (F.col("l_partkey") % 10).cast("int").alias("repeatId"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sample"), F.when(F.col("l_linenumber") % 4 == 0, "pred").otherwise("cal").alias("role"),
        F.col("l_extendedprice").alias("actual"), (F.col("l_extendedprice") + noise * size * F.lit(60000.0)).alias("predicted"),
    )


SIGNALS_SQL = f"t0 AS (SELECT vec_id AS sample_id, CASE WHEN vec_id % 4 = 0 THEN 'pred' ELSE 'cal' END AS role, p - 1 AS pos, embedding[p]::DOUBLE AS v FROM embeddings, unnest(range(1, {CHANNELS + 1})) AS r(p))"
REFERENCE_SQL = """ref AS (
  SELECT 'T1' AS target, vec_id AS sample_id, 50.0::DOUBLE + 20.0::DOUBLE * embedding[4]::DOUBLE - 15.0::DOUBLE * embedding[11]::DOUBLE + label AS value FROM embeddings
  UNION ALL SELECT 'T2', vec_id, 30.0::DOUBLE + 10.0::DOUBLE * embedding[6]::DOUBLE + 5.0::DOUBLE * embedding[21]::DOUBLE FROM embeddings)"""
PREDICTIONS_SQL = """pred AS (
  SELECT l_returnflag AS target, 'A' || (l_suppkey % 10) AS "modelName", (l_partkey % 10)::INT AS "repeatId", l_orderkey * 10 + l_linenumber AS sample, CASE WHEN l_linenumber % 4 = 0 THEN 'pred' ELSE 'cal' END AS role, l_extendedprice AS actual,
    l_extendedprice + (((l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % 1000)::DOUBLE / 1000.0::DOUBLE - 0.5::DOUBLE) * (0.2::DOUBLE + 0.2::DOUBLE * (l_suppkey % 10) + CASE WHEN l_suppkey % 10 = 9 AND l_partkey % 10 = 0 THEN 12.0::DOUBLE ELSE 0.0::DOUBLE END) * 60000.0::DOUBLE AS predicted
  FROM lineitem)"""
METRICS_SQL = (
    PREDICTIONS_SQL
    + """,
m AS (
  SELECT *, s / greatest("RMSEP", 1e-12) AS "RPD" FROM (
    SELECT target, "modelName", "repeatId",
      CASE WHEN count(*) FILTER (role = 'cal') >= 2 AND stddev_pop(actual) FILTER (role = 'cal') >= 1e-12 THEN 1 - sum((actual - predicted) ** 2) FILTER (role = 'cal') / (var_pop(actual) FILTER (role = 'cal') * count(*) FILTER (role = 'cal')) END AS "Rc2",
      CASE WHEN count(*) FILTER (role = 'pred') >= 2 AND stddev_pop(actual) FILTER (role = 'pred') >= 1e-12 THEN 1 - sum((actual - predicted) ** 2) FILTER (role = 'pred') / (var_pop(actual) FILTER (role = 'pred') * count(*) FILTER (role = 'pred')) END AS "Rp2",
      coalesce(sqrt(avg((actual - predicted) ** 2) FILTER (role = 'cal')), 'inf'::DOUBLE) AS "RMSEC", coalesce(sqrt(avg((actual - predicted) ** 2) FILTER (role = 'pred')), 'inf'::DOUBLE) AS "RMSEP", coalesce(avg(abs(actual - predicted)) FILTER (role = 'pred'), 'inf'::DOUBLE) AS "MAE",
      stddev_pop(actual) FILTER (role = 'pred') AS s, count(*) FILTER (role = 'cal') AS "nCalibration", count(*) FILTER (role = 'pred') AS "nPrediction"
    FROM pred GROUP BY ALL)),
c AS (SELECT *, coalesce("Rp2" >= 0.75 AND abs("Rc2" - "Rp2") <= 0.20, false) AS criterion, coalesce("Rp2" < -10, false) AS severe FROM m)"""
)

"""Ranking, manifests and export order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayline.functions.columns import or_null

#: Columns of the metric and prediction tables, in order.
METRIC_COLUMNS = ("target", "modelName", "preprocess", "yTransform", "trainRatio", "repeatId", "splitId", "Rc2", "Rp2", "RMSEC", "RMSEP", "MAE", "RPD", "nSamples", "nFeatures", "nEffectiveVariables", "elapsedSec")
PREDICTION_COLUMNS = ("target", "modelName", "preprocess", "yTransform", "setType", "sampleName", "actualValue", "predictedValue", "error", "absError", "trainRatio", "repeatId", "splitId", "Rc2", "Rp2", "RMSEC", "RMSEP", "MAE", "RPD")


def _best_first(seq: str) -> list[Column]:
    """Rp2 downwards with NaN and null last, RMSEP upwards, then the order of running."""
    return [or_null(F.col("Rp2")).desc_nulls_last(), or_null(F.col("RMSEP")).asc_nulls_last(), F.col(seq).asc()]


def best_by(metrics: DataFrame, keys: Sequence[str], seq: str = "splitId") -> DataFrame:
    """The best row of each key, found by an aggregate: a task passes on one row a key."""
    rp2, rmsep = or_null(F.col("Rp2")), or_null(F.col("RMSEP"))
    return _least(metrics, keys, F.struct(rp2.isNull(), -rp2, rmsep.isNull(), rmsep, F.col(seq)))


def top_n(metrics: DataFrame, n: int = 50, seq: str = "splitId") -> DataFrame:
    """The n best rows of all: a top-k, not a full sort."""
    return metrics.orderBy(*_best_first(seq)).limit(n)


def export_order(metrics: DataFrame, targets: DataFrame, seq: str = "splitId") -> DataFrame:
    """metrics by the order of targets (target, ordinal), those not listed last, then best first."""
    joined = metrics.join(targets, "target", "left")
    return joined.orderBy(F.col("ordinal").asc_nulls_last(), *_best_first(seq)).drop("ordinal")


def prediction_order(details: DataFrame, targets: DataFrame) -> DataFrame:
    """details by the order of targets (target, ordinal), those not listed last, then model, set and sample."""
    joined = details.join(targets, "target", "left")
    return joined.orderBy(F.col("ordinal").asc_nulls_last(), "modelName", "setType", "sampleName").drop("ordinal")


def fixed_schema(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exactly the columns, in order: missing ones null, others dropped."""
    kinds = {f.name: f.dataType for f in METRICS_SCHEMA} | {c: T.DoubleType() for c in ("actualValue", "predictedValue", "error", "absError") if c in PREDICTION_COLUMNS and c in columns and "actualValue" in columns}
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(kinds.get(c, T.StringType())).alias(c) for c in columns])


def first_of_each(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key, nulls first, by an aggregate."""
    return _least(rows, keys, F.struct(*order))


def _least(rows: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    whole = F.min_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), order)
    return rows.groupBy(*keys).agg(whole.alias("_row")).select("_row.*")


def prediction_details(predictions: DataFrame) -> DataFrame:
    """predictions (actual, predicted, role, ...) with setType, error and absError."""
    error = F.col("predicted") - F.col("actual")
    return predictions.withColumn("setType", F.when(F.col("role") == "cal", "Calibration").otherwise("Prediction")).withColumn("error", error).withColumn("absError", F.abs(error))


def composite_split_id(transform: Column, recipe: Column, ratio: Column, repeat: Column, transforms: Sequence[str], recipes: Sequence[str], ratios: Sequence[float], repeats: int) -> Column:
    """The configuration's number: ((transform * recipes + recipe) * ratios + ratio) * repeats + repeat, repeats from 1."""

    def at(values, c: Column) -> Column:
        return F.array_position(F.array(*[F.lit(v) for v in values]), c) - 1

    return (((at(transforms, transform) * len(recipes) + at(recipes, recipe)) * len(ratios) + at(ratios, ratio)) * repeats + repeat).cast("bigint")


METRICS_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("target", "modelName", "preprocess", "yTransform")]
    + [T.StructField("trainRatio", T.DoubleType()), T.StructField("repeatId", T.IntegerType()), T.StructField("outerSplitId", T.IntegerType()), T.StructField("splitId", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in ("Rc2", "Rp2", "RMSEC", "RMSEP", "MAE", "RPD")]
    + [T.StructField(c, T.IntegerType()) for c in ("nSamples", "nCalibrationUsed", "nPrediction", "nFeatures", "nEffectiveVariables")]
    + [T.StructField("predictions", T.ArrayType(T.StructType([T.StructField("sample_id", T.StringType()), T.StructField("role", T.StringType()), T.StructField("actual", T.DoubleType()), T.StructField("predicted", T.DoubleType())])))]
    + [T.StructField("warningMessages", T.ArrayType(T.StringType())), T.StructField("elapsedSec", T.DoubleType()), T.StructField("error", T.StringType())]
)

"""What a job has done by target, observed while it runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SCHEMA = "target string, tasks bigint, failures bigint, warnings bigint"


def observed(rows: DataFrame, targets: Sequence[str], failed: Column, warnings: Column) -> tuple[DataFrame, Observation]:
    """rows as they are, and an observation that counts them, those that failed and their warnings, by target.

    targets are a study's analytes, each of them three figures. The figures come
    with the action that reads the rows, so they cost no pass of their own; rows
    of other targets are in none. An action that fails gives none.
    """
    watch = Observation()
    figures = []
    for i, t in enumerate(targets):
        own = F.col("target").eqNullSafe(F.lit(t))
        figures += [F.count_if(own).alias(f"tasks{i}"), F.count_if(own & F.coalesce(failed, F.lit(False))).alias(f"failures{i}"), F.coalesce(F.sum(F.when(own, warnings)), F.lit(0)).cast("bigint").alias(f"warnings{i}")]
    return (rows.observe(watch, *figures), watch) if figures else (rows, watch)


def figures(spark: SparkSession, watch: Observation, targets: Sequence[str]) -> DataFrame:
    """(target, tasks, failures, warnings) of an observation whose action has run."""
    got = watch.get if targets else {}
    return spark.createDataFrame([(t, got[f"tasks{i}"], got[f"failures{i}"], got[f"warnings{i}"]) for i, t in enumerate(targets)], SCHEMA)

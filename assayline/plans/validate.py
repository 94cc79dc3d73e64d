"""Validation reports: one row for each check instead of a stop at the first failure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check(one_row: DataFrame, name: str, expected: str) -> DataFrame:
    """(check_name, expected, actual, passed) of a frame with one row and a column `actual`."""
    actual = F.col("actual").cast("string")
    return one_row.select(F.lit(name).alias("check_name"), F.lit(expected).alias("expected"), actual.alias("actual"), (actual == expected).alias("passed"))


def file_report(files: DataFrame, max_bytes: int = 25 * 1024 * 1024, forbidden: str = "[\\u4e00-\\u9fff]") -> DataFrame:
    """(path, length, too_large, forbidden_text) of a binaryFile scan."""
    text = F.decode("content", "UTF-8")
    return files.select("path", "length", (F.col("length") >= max_bytes).alias("too_large"), F.coalesce(text.rlike(forbidden), F.lit(False)).alias("forbidden_text"))


def published_counts(manifest: DataFrame, expected: dict[str, int], total: int) -> DataFrame:
    """For each abbreviation of an exclusion manifest (abbreviation, status): included as expected, and included + excluded = total."""
    got = manifest.groupBy("abbreviation").pivot("status", ["included", "excluded"]).count().na.fill(0)
    want = manifest.sparkSession.createDataFrame(list(expected.items()), "abbreviation string, expected bigint")
    joined = want.join(got, "abbreviation", "left").na.fill(0)
    return joined.withColumn("passed", (F.col("included") == F.col("expected")) & (F.col("included") + F.col("excluded") == total))

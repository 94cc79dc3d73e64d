"""Wide study tables and manifests as long DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.functions.columns import or_null

#: Header spellings of exclusion lists, compared without case, spaces, dashes and underscores.
ALIASES = {
    "target": ("target", "analyte", "indicator", "targetlabelinreferencefile"),
    "sample_id": ("samplename", "sample", "sampleid"),
    "reason": ("reason", "exclusionreason"),
    "status": ("status",),
}


def read_wide(spark: SparkSession, path: str) -> DataFrame:
    """A wide table as text columns, by the path's ending: .parquet, .xlsx or else CSV with a header."""
    if path.endswith(".parquet"):
        df = spark.read.parquet(path)
        return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    if path.endswith((".xlsx", ".xls")):
        from assayline.sources.workbook import read_sheet

        return read_sheet(spark, path)
    df = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    return df.withColumnsRenamed({c: c.lstrip("﻿") for c in df.columns})


def _numbered(wide: DataFrame) -> DataFrame:
    """Adds row_no, the order of the file: a wide table is one small file, so its rows are numbered in one partition."""
    return wide.coalesce(1).withColumn("row_no", F.monotonically_increasing_id())


def spectra(wide: DataFrame) -> tuple[DataFrame, list[float]]:
    """(sample_id, seq, x array<double>) and the axis, from a table with the axis first and a column for each sample.

    Text that is no finite number becomes null in x. seq is the column's place.
    """
    axis_name, *samples = wide.columns
    rows = _numbered(wide)
    axis = [r[0] for r in rows.orderBy("row_no").select(or_null(F.col(f"`{axis_name}`").try_cast("double"))).collect()]  # a row for each channel
    pairs = F.array(*[F.struct(F.lit(s.strip()).alias("sample_id"), F.lit(i).alias("seq"), or_null(F.col(f"`{s}`").try_cast("double")).alias("v")) for i, s in enumerate(samples)])
    long = rows.select("row_no", F.inline(pairs))
    x = F.transform(F.sort_array(F.collect_list(F.struct("row_no", "v"))), lambda p: p.v)
    return long.groupBy("sample_id", "seq").agg(x.alias("x")), axis


def reference(wide: DataFrame) -> DataFrame:
    """(target, target_no, sample_id, seq, value) from a table with the target's name first; a blank or 'nan' name becomes Analyte<n>."""
    name, *samples = wide.columns
    rows = _numbered(wide)
    label = F.trim(F.coalesce(F.col(f"`{name}`"), F.lit("")))
    label = F.when((label == "") | (F.lower(label) == "nan"), F.concat(F.lit("Analyte"), (F.col("row_no") + 1).cast("string"))).otherwise(label)
    pairs = F.array(*[F.struct(F.lit(s.strip()).alias("sample_id"), F.lit(i).alias("seq"), or_null(F.col(f"`{s}`").try_cast("double")).alias("value")) for i, s in enumerate(samples)])
    return rows.select(label.alias("target"), F.col("row_no").alias("target_no"), F.inline(pairs))


def exclusions(spark: SparkSession, path: str | None) -> DataFrame:
    """(target, sample_id, reason, seq) of an exclusion list; None is an empty list, a missing file an error.

    With a status column only its 'excluded' rows count, so that a full manifest can be given.
    """
    schema = "target string, sample_id string, reason string, seq bigint"
    if path is None:
        return spark.createDataFrame([], schema)
    wide = read_wide(spark, path)
    plain = {c: c.lower().replace("_", "").replace("-", "").replace(" ", "") for c in wide.columns}
    found = {k: next((c for a in names for c, p in plain.items() if p == a), None) for k, names in ALIASES.items()}
    if found["target"] is None or found["sample_id"] is None:
        raise ValueError(f"{path}: no column for the target or the sample in {wide.columns}")
    rows = _numbered(wide)
    if found["status"]:
        rows = rows.where(F.lower(F.trim(F.col(f"`{found['status']}`"))) == "excluded")

    def text(k: str):
        return F.trim(F.coalesce(F.col(f"`{found[k]}`"), F.lit(""))) if found[k] else F.lit("")

    out = rows.select(text("target").alias("target"), text("sample_id").alias("sample_id"), text("reason").alias("reason"), F.col("row_no").alias("seq"))
    return out.where("target != '' and sample_id != ''")


def specification(spark: SparkSession, path: str) -> DataFrame:
    """A JSON specification as one row."""
    return spark.read.option("multiLine", True).json(path)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """path, length and content of all files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)

"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, one of our own if all run on this machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="assayline-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    This cuts the lineage: a lost executor costs only a re-read. Void columns
    are not supported. The files go when the application ends, or earlier
    through `release`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/durable-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _filesystem(spark, path)[0].deleteOnExit(_filesystem(spark, path)[1])
    out = spark.read.schema(df.schema).parquet(path)
    out._assayline_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete the files of a `durable` result that nothing reads any more."""
    path = getattr(df, "_assayline_path", None)
    if path:
        fs, p = _filesystem(df.sparkSession, path)
        fs.delete(p, True)


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p

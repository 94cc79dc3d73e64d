"""Result sets on disk and the resumable store of a study."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.sources.digests import table_digest


def write_tables(tables: dict[str, DataFrame], folder: str, kind: str = "parquet", max_rows: int = 1_000_000, mark: bool = False) -> None:
    """Each table into folder/name; CSV as one file for each million rows with a header, which with `mark` begins with a byte order mark for spreadsheets."""
    for name, df in tables.items():
        if kind == "csv":
            flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])
            flat = flat.withColumnRenamed(flat.columns[0], "\ufeff" + flat.columns[0]) if mark else flat
            flat.write.mode("overwrite").option("header", True).option("maxRecordsPerFile", max_rows).csv(f"{folder}/{name}")
        else:
            df.write.mode("overwrite").option("maxRecordsPerFile", max_rows).parquet(f"{folder}/{name}")


class Store:
    """A study's results by target under one folder, bound to a signature.

    Appends go through Spark's commit protocol, a target's partition is
    replaced whole, and a folder with another signature is refused.
    """

    def __init__(self, spark: SparkSession, folder: str, signature: str):
        self.spark, self.folder, self.signature = spark, folder, signature
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._bind()

    def _bind(self) -> None:
        at = f"{self.folder}/_signature"
        if self._fs.exists(self._path(at)):
            stored = json.loads(self.spark.read.text(at, wholetext=True).first()[0])["signature"]
            if stored != self.signature:
                raise ValueError(f"{self.folder} holds a study with other settings or inputs ({stored[:12]}, not {self.signature[:12]})")
        else:
            self.spark.createDataFrame([(json.dumps({"signature": self.signature}),)], "value string").coalesce(1).write.text(at)

    def save(self, results: DataFrame) -> None:
        """Replace the partitions of the targets in results."""
        results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("target").parquet(f"{self.folder}/results")

    def note(self, figures: DataFrame) -> None:
        """Keep what was observed while targets were saved."""
        figures.withColumn("saved_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.folder}/observed")

    def notes(self) -> DataFrame | None:
        """The last figures of each target."""
        if not self._fs.exists(self._path(f"{self.folder}/observed")):
            return None
        rows = self.spark.read.parquet(f"{self.folder}/observed")
        last = F.max_by(F.struct(*[c for c in rows.columns if c not in ("target", "saved_at")]), "saved_at")
        return rows.groupBy("target").agg(last.alias("f")).select("target", "f.*")

    def load(self) -> DataFrame | None:
        return self.spark.read.option("basePath", f"{self.folder}/results").parquet(f"{self.folder}/results") if self._fs.exists(self._path(f"{self.folder}/results")) else None


def provenance(spectra: DataFrame, reference: DataFrame) -> dict[str, str]:
    """Row counts and order-free SHA-256 digests of a study's inputs, for its signature."""

    def digest(df: DataFrame) -> str:
        row = table_digest(df).first()
        return f"{row.n}:{row.digest}"

    return {"spectra": digest(spectra.select("sample_id", "x")), "reference": digest(reference.select("target", "sample_id", "value"))}

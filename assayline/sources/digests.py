"""Digests of inputs: SHA-256 of files, and of tables whatever the order of their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LIMBS = 8


def file_digests(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, length, sha256) of the files at or below each path; a file is read by one task and may have 2 GB at most."""
    found = [spark.read.format("binaryFile").option("recursiveFileLookup", True).load(p) for p in paths]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select("path", "length", F.sha2("content", 256).alias("sha256"))


def row_text(df: DataFrame) -> Column:
    """A row as one text that tells apart every column, null and value: name=length:value for each column in order, ~ for null."""
    parts = []
    for c in df.columns:
        v = F.col(f"`{c}`").cast("string")
        parts.append(F.concat(F.lit(f"{c}="), F.coalesce(F.concat(F.char_length(v).cast("string"), F.lit(":"), v), F.lit("~")), F.lit(";")))
    return F.concat(*parts) if parts else F.lit("")


def table_digest(df: DataFrame) -> DataFrame:
    """One row (n, digest): the number of rows and the sum of their SHA-256, modulo 2 to the 256th, as 64 hex digits.

    Equal for any order or partitioning of the rows; repeated rows count. Sums of
    eight 32-bit parts are taken where the rows are; carries are settled once. An
    empty table has n 0 and digits 0.
    """
    h = df.select(F.sha2(row_text(df), 256).alias("h"))
    sums = h.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias(f"s{i}") for i in range(_LIMBS)])
    base = F.lit(1 << 32).cast("decimal(38,0)")
    out = sums.withColumn("carry", F.lit(0).cast("decimal(38,0)"))
    for i in reversed(range(_LIMBS)):
        whole = (F.col(f"s{i}") + F.col("carry")).cast("decimal(38,0)")
        out = out.withColumn("whole", whole)
        out = out.withColumn(f"d{i}", F.lpad(F.lower(F.hex((F.col("whole") % base).cast("bigint"))), 8, "0")).withColumn("carry", F.expr(f"cast(whole div {1 << 32} as decimal(38,0))"))
    return out.select("n", F.concat(*[f"d{i}" for i in range(_LIMBS)]).alias("digest"))


def table_digest_sql(table: str, columns: list[tuple[str, str]]) -> str:
    """The same in SQL, for columns given as (name, text expression)."""
    line = " || ".join(f"'{n}=' || coalesce(length({v}) || ':' || {v}, '~') || ';'" for n, v in columns)
    sums = ", ".join(f"coalesce(sum(('0x' || substr(h, {8 * i + 1}, 8))::BIGINT), 0)::HUGEINT AS s{i}" for i in range(_LIMBS))
    steps, before = [], "0::HUGEINT"
    for i in reversed(range(_LIMBS)):
        steps.append(f"c{i} AS (SELECT *, s{i} + ({before}) AS w{i} FROM {f'c{i + 1}' if i < _LIMBS - 1 else 's'})")
        before = f"w{i} // 4294967296"
    digits = " || ".join(f"printf('%08x', (w{i} % 4294967296)::BIGINT)" for i in range(_LIMBS))
    return f"WITH s AS (SELECT count(*) AS n, {sums} FROM (SELECT sha256({line}) AS h FROM {table})), {', '.join(steps)} SELECT n::BIGINT AS n, {digits} AS digest FROM c0"

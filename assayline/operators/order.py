"""Places within groups without one task a group: range partitions, counts and prefix sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayline.sources.shared import durable

_PART = 33  # monotonically_increasing_id: the partition above these bits, the row within it below


def ranked(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], rank: str = "rank", size: str = "n") -> DataFrame:
    """rows with rank, each row's place from 0 within its keys by `order`, and size, its group's rows, both bigint.

    All rows are range-partitioned and sorted by keys and order, so that a group
    of any size lies over as many tasks as it needs. Each partition counts its
    rows by key; a row's place is its place in the partition plus the counts of
    the key's earlier partitions. The prefix sums run over one row for each key
    and partition that meet. Null keys are a group. Rows that are equal in all of
    `order` get different places in an order that isn't defined; give a complete
    order where that matters. An empty table gives an empty result. The sorted
    rows are written to the shared folder, as partition bounds may not be drawn
    twice. No column may be named like `rank`, `size` or begin with `_order_`.
    """
    keys = list(keys)
    by = [*(F.col(k) for k in keys), *(F.col(o) if isinstance(o, str) else o for o in order)]
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = durable(rows.repartitionByRange(tasks, *by).sortWithinPartitions(*by).withColumn("_order_at", F.monotonically_increasing_id()))
    part = F.shiftright("_order_at", _PART)
    counts = placed.groupBy(*keys, part.alias("_order_part")).agg(F.count("*").alias("_order_n"), F.min("_order_at").alias("_order_first"))
    of_key = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    counts = counts.select(
        *[F.col(k).alias(f"_order_k{i}") for i, k in enumerate(keys)], "_order_part",
        (F.sum("_order_n").over(of_key.orderBy("_order_part").rowsBetween(W.unboundedPreceding, 0)) - F.col("_order_n") - F.col("_order_first")).alias("_order_shift"),
        F.sum("_order_n").over(of_key).alias(size),
    )
    same = part == F.col("_order_part")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_order_k{i}"))
    return placed.join(counts, same).select(*rows.columns, (F.col("_order_at") + F.col("_order_shift")).alias(rank), size)

"""Response-stratified splits, folds and the factorial of tasks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.config import Config, stable_seed
from assayline.functions.columns import half_even
from assayline.operators.order import ranked


def response_bins(rows: DataFrame, keys: Sequence[str] = ("target",)) -> DataFrame:
    """rows (keys, sample_id, value) with n, n_bins and bin: equal ranges of the value's rank, remainders spread (not ntile).

    Nulls come first, then values upwards and NaN; equal values by sample_id. Ranks
    come from range partitions (`order.ranked`), so one target may hold all rows.
    """
    out = ranked(rows, keys, ["value", "sample_id"])
    out = out.withColumn("n_bins", F.least(F.lit(5), F.greatest(F.lit(2), F.floor(F.col("n") / 12))).cast("int"))
    # the bin b with floor(b * n / B) <= rank < floor((b + 1) * n / B)
    return out.withColumn("bin", (F.floor(((F.col("rank") + 1) * F.col("n_bins") - 1) / F.col("n"))).cast("int"))


def outer_splits(rows: DataFrame, config: Config) -> DataFrame:
    """(target, outer_split_id, train_ratio, repeat_id, sample_id, role) for every split of rows (target, sample_id, value).

    In each bin the samples with the least SHA-256 of (seed, sample) calibrate,
    half-even ratio of the bin and one at least; then the whole is trimmed or
    topped up by the same order to the ratio of all. The hash takes the place of
    a random generator, so the split doesn't depend on partitions or order.
    Places within a bin and within a split are ranks over range partitions.
    """
    plans = [
        (i + 1, float(r), rep, stable_seed(config.random_state, "outer_split", f"{r:.6f}", rep))
        for i, (r, rep) in enumerate((r, rep) for r in config.ratios for rep in range(1, config.repeats + 1))
    ]
    dims = rows.sparkSession.createDataFrame(plans, "outer_split_id int, train_ratio double, repeat_id int, seed bigint")
    binned = response_bins(rows).select("target", "sample_id", "n", "bin")
    out = binned.crossJoin(F.broadcast(dims))  # a row for each ratio and repeat of the settings
    out = out.withColumn("order", F.sha2(F.concat_ws("|", "seed", "sample_id"), 256)).drop("seed")
    split = ["target", "outer_split_id"]
    n_train = F.least(F.greatest(F.lit(2), half_even(F.col("train_ratio") * F.col("n"))), F.col("n") - 1)
    out = ranked(out, [*split, "bin"], ["order", "sample_id"], "own", "size")
    out = out.withColumn("first", F.col("own") < F.greatest(F.lit(1), half_even(F.col("train_ratio") * F.col("size")))).drop("own", "size")
    out = ranked(out, split, [F.desc("first"), "order", "sample_id"], "place", "all")
    return out.select(*split, "train_ratio", "repeat_id", "sample_id", F.when(F.col("place") < n_train, "cal").otherwise("pred").alias("role"))


def check_splits(splits: DataFrame, reference: DataFrame) -> DataFrame:
    """(target, outer_split_id, ok): at least 8 calibration and 5 prediction samples, whose values vary."""
    rows = splits.join(reference, ["target", "sample_id"])
    pred = F.when(F.col("role") == "pred", F.col("value"))
    ok = (F.count_if(F.col("role") == "cal") >= 8) & (F.count(pred) >= 5) & (F.stddev_pop(pred) >= 1e-12)
    return rows.groupBy("target", "outer_split_id").agg(F.coalesce(ok, F.lit(False)).alias("ok"))


def factorial(spark: SparkSession, config: Config) -> DataFrame:
    """(algorithm, y_transform, preprocess, train_ratio, repeat_id, split_id): every task of a target, a product of small dimensions."""
    from assayline.operators.ranking import composite_split_id

    def dim(name: str, values, kind: str) -> DataFrame:
        return spark.createDataFrame([(v,) for v in values], f"{name} {kind}")

    tasks = dim("algorithm", config.algorithms, "string")
    for d in (dim("y_transform", config.transforms, "string"), dim("preprocess", config.recipes, "string"), dim("train_ratio", config.ratios, "double"), dim("repeat_id", range(1, config.repeats + 1), "int")):
        tasks = tasks.crossJoin(F.broadcast(d))
    return tasks.withColumn("split_id", composite_split_id(F.col("y_transform"), F.col("preprocess"), F.col("train_ratio"), F.col("repeat_id"), config.transforms, config.recipes, config.ratios, config.repeats))


def folds(n: int, k: int, repeats: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Repeated shuffled k-fold: (train, test) positions, the first n % k folds one longer, a seed for each repeat."""
    k = max(2, min(k, n))
    out = []
    for rep in range(repeats):
        order = np.arange(n)
        np.random.RandomState(stable_seed(seed, "inner_cv", rep)).shuffle(order)
        for test in np.array_split(order, k):
            mask = np.zeros(n, bool)
            mask[test] = True
            out.append((np.flatnonzero(~mask), np.flatnonzero(mask)))
    return out

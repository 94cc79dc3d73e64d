"""Monte-Carlo cross-validation of one-component models over whole targets, as sums by iteration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.functions.columns import EPS, dot, finite, guarded, half_even, uniform
from assayline.operators.farthest import part, spread, standardised
from assayline.operators.order import ranked
from assayline.sources.shared import durable

_BLOCK = 2048


def held_out_means(rows: DataFrame, channels: int, iterations: int, ratio: float, seed: int, least_n: int = 15) -> DataFrame:
    """(target, sample_id, mean_error, n_predicted): each sample's mean absolute error over the iterations that hold it out.

    rows: target, sample_id (unique within a target), x, y. In each iteration the
    half-even ratio * n samples of the least hash of (seed, target, iteration, sample)
    calibrate, 8 at least; the rest is predicted by a PLS model of one component on
    standardised channels (ddof 1). Rows with null or non-finite values, another
    number of channels or no target are left out; targets of fewer than
    least_n usable rows, or whose values don't vary, give none.

    A sample's flags, one for each iteration, stand in its own row, so that a
    product of flags and values gives a task's sums for all iterations at once. Only
    sums by iteration and channel are shuffled: weights follow from the first, the
    inner regression from the second sums, and errors are averaged where the sample
    is. A model is one weight a channel, so a target's models are
    iterations * channels numbers, joined to its rows part by part (`spread`), so
    that neither a join nor a product has a target's rows in one task.
    """
    able = standardised(rows.where(finite(F.col("y").cast("double")) & F.col("target").isNotNull()).withColumn("y", F.col("y").cast("double")), ["target"], channels, "y").withColumn("_part", part())
    able = durable(able)
    level = able.groupBy("target").agg(F.count("*").alias("n"), F.avg("y").alias("_my"), F.stddev_pop("y").alias("_sy")).where((F.col("n") >= least_n) & (F.col("_sy") >= EPS))
    sizes = durable(level.select("target", "n"))
    able = durable(able.join(spread(level, "n").drop("n"), ["target", "_part"]).select("target", "_part", "sample_id", "x", ((F.col("y") - F.col("_my")) / F.col("_sy")).alias("y"), "_sy"))
    draws = able.select("target", "sample_id", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("i"))
    placed = ranked(draws.withColumn("u", uniform(F.lit(seed), F.lit("mccv"), F.col("target"), F.col("i"), F.col("sample_id"))), ["target", "i"], ["u", "sample_id"], "place", "n")
    cal = F.col("place") < F.greatest(F.lit(8), half_even(ratio * F.col("n")))
    flags = placed.groupBy("target", "sample_id").agg(F.sort_array(F.collect_list(F.struct("i", cal.alias("c")))).alias("f")).select("target", "sample_id", F.col("f.c").alias("cal"))  # one flag an iteration
    wide = durable(able.join(flags, ["target", "sample_id"]))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            for at in range(0, len(b), _BLOCK):
                part = b.slice(at, _BLOCK)
                name = np.array(part.column("target").to_pylist(), object)
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(part), channels)
                c = part.column("cal").flatten().to_numpy(zero_copy_only=False).reshape(len(part), iterations).astype(float)
                y = part.column("y").to_numpy(zero_copy_only=False)[:, None]
                z = np.concatenate((np.ones_like(y), y, y * y, x, x * x, x * y), axis=1)
                for t in set(name.tolist()):
                    own = name == t
                    held[t] = held.get(t, 0) + c[own].T @ z[own]
            if len(held) > 64:  # bounded where targets are many
                yield lined(held)
                held = {}
        if held:
            yield lined(held)

    def lined(held: dict[str, np.ndarray]) -> pa.RecordBatch:
        n = iterations * channels
        columns = [pa.array([t for t in held for _ in range(n)], pa.string()), pa.array(np.tile(np.repeat(np.arange(iterations), channels), len(held)).astype(np.int32)), pa.array(np.tile(np.arange(channels), len(held) * iterations).astype(np.int32))]
        for k in range(3):
            columns.append(pa.array(np.concatenate([np.repeat(m[:, k], channels) for m in held.values()])))
        for k in range(3):
            columns.append(pa.array(np.concatenate([m[:, 3 + k * channels : 3 + (k + 1) * channels].ravel() for m in held.values()])))
        return pa.RecordBatch.from_arrays(columns, ["target", "i", "pos", "n", "sy", "syy", "sx", "sxx", "sxy"])

    names = ["n", "sy", "syy", "sx", "sxx", "sxy"]
    total = wide.select("target", "x", "y", "cal").mapInArrow(sums, "target string, i int, pos int, " + ", ".join(f"{n} double" for n in names)).groupBy("target", "i", "pos").agg(*[F.sum(n).alias(n) for n in names])
    n = F.col("n")
    sd_x = guarded(F.sqrt(F.greatest((F.col("sxx") - F.col("sx") * F.col("sx") / n) / (n - 1), F.lit(0.0))))
    sd_y = guarded(F.sqrt(F.greatest((F.col("syy") - F.col("sy") * F.col("sy") / n) / (n - 1), F.lit(0.0))))
    weights = total.select("target", "i", "pos", (F.col("sx") / n).alias("m"), sd_x.alias("s"), (F.col("sy") / n).alias("my"), sd_y.alias("sd"), ((F.col("sxy") - F.col("sx") * F.col("sy") / n) / sd_x / sd_y).alias("w"))
    each = weights.groupBy("target", "i").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"), F.sum(F.col("m") * F.col("w") / F.col("s")).alias("shift"), F.sort_array(F.collect_list(F.struct("pos", (F.col("w") / F.col("s")).alias("b")))).alias("b"), F.first("my").alias("my"), F.first("sd").alias("sd"))
    by = F.when(F.col("size") < EPS, 0.0).otherwise(1 / F.col("size"))
    each = durable(each.select("target", "i", F.transform("b.b", lambda v: v * by).alias("b"), (-F.col("shift") * by).alias("a"), "my", "sd"))
    models = each.groupBy("target").agg(F.sort_array(F.collect_list(F.struct("i", "a", "b"))).alias("models"))
    told = spread(models.join(sizes, "target"), "n").drop("n")
    scored = durable(wide.join(told, ["target", "_part"]).select("target", "_part", "sample_id", "y", "_sy", "cal", F.transform("models", lambda m: m["a"] + dot(F.col("x"), m["b"])).alias("t")))
    inner = scored.select("target", "y", F.posexplode(F.arrays_zip("cal", "t")).alias("i", "m")).where("m.cal").select("target", "i", "y", F.col("m.t").alias("t"))
    inner = inner.groupBy("target", "i").agg(F.sum(F.col("t") * F.col("t")).alias("tt"), F.sum(F.col("t") * F.col("y")).alias("ty"), F.sum("t").alias("st")).join(each, ["target", "i"])
    inner = inner.select("target", "i", "my", (F.col("sd") * F.when(F.col("tt") < 1e-14, 0.0).otherwise((F.col("ty") - F.col("my") * F.col("st")) / F.col("sd") / F.col("tt"))).alias("q"))
    inner = inner.groupBy("target").agg(F.sort_array(F.collect_list(F.struct("i", "my", "q"))).alias("q"))
    inner = spread(inner.join(sizes, "target"), "n").drop("n")
    errors = F.transform(F.filter(F.arrays_zip("cal", "t", "q"), lambda m: ~m["cal"]), lambda m: F.abs(F.col("y") - m["q"]["my"] - m["q"]["q"] * m["t"]))
    out = scored.join(inner, ["target", "_part"]).select("target", "sample_id", "_sy", errors.alias("e")).where("size(e) > 0")
    return out.select("target", "sample_id", (F.col("_sy") * F.aggregate("e", F.lit(0.0), lambda s, v: s + v) / F.size("e")).alias("mean_error"), F.size("e").cast("bigint").alias("n_predicted"))

"""Exact quantiles by brackets: counts narrow the values around each rank, nothing buffers a group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_GRID = 128
_ACCURACY = 20 * _GRID  # a sketch's ranks are wrong by a twentieth of a grid step at most
_MARGIN = 2


def _bracket(grid: Column, before: Column, inside: Column, first: Column, last: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """Values below and above the ranks first and last, of a grid over the `inside` values of low to high after `before` others; the ends stay where the grid ends."""
    a = F.floor((first - before) / inside * _GRID).cast("int") - _MARGIN
    b = F.ceil((last + 1 - before) / inside * _GRID).cast("int") + _MARGIN
    return F.when(a > 0, F.get(grid, a)).otherwise(low), F.when(b < _GRID, F.get(grid, b)).otherwise(high)


def quantiles(rows: DataFrame, keys: Sequence[str], value: Column | str, probs: Mapping[str, float], passes: int = 2) -> DataFrame:
    """(keys, names of probs...): each key's exact quantiles of value, interpolated linearly between its two neighbouring ranks.

    Nulls are left out, NaN is the greatest value; a key without values has no row.
    Null keys are a group. The first pass counts and draws a grid of approximate
    quantiles (a sketch of bounded size); the grid values around a rank are a
    bracket that surely holds it. Each further pass counts the values before and within a
    bracket and narrows it to a thirtieth. The last groups what is left by
    value, so ties are one row, and sums counts up to the rank: the values of a
    bracket stream through that sum, the others are one count. `passes` doesn't
    change results, only how much is left for the last step.
    """
    keys, names = list(keys), list(probs)
    v = F.col(value) if isinstance(value, str) else value
    base = rows.select(*keys, v.cast("double").alias("_v")).where("_v is not null")
    at = [F.lit(i / _GRID) for i in range(_GRID + 1)]

    def grid(c: Column) -> Column:
        return F.percentile_approx(c, F.array(*at), _ACCURACY)

    low, high = F.lit(float("-inf")), F.lit(float("nan"))  # nothing is below or above them
    state = base.groupBy(*keys).agg(F.count("*").alias("_n"), grid(F.col("_v")).alias("_g"))
    ranks = {n: (F.floor(p * (F.col("_n") - 1)), F.ceil(p * (F.col("_n") - 1))) for n, p in probs.items()}
    ends = []
    for i, n in enumerate(names):
        a, b = _bracket(F.col("_g"), F.lit(0), F.col("_n"), *ranks[n], low, high)
        ends += [a.alias(f"_lo{i}"), b.alias(f"_hi{i}")]
    state = state.select(*keys, "_n", *ends)

    def joined(state: DataFrame) -> DataFrame:
        if not keys:
            return base.crossJoin(F.broadcast(state))  # one row
        named = state.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in state.columns if c not in keys])
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        return base.join(named, same)

    for _ in range(passes - 1):
        sums = [F.first("_n").alias("_n")]
        for i in range(len(names)):
            inside = (F.col("_v") >= F.col(f"_lo{i}")) & (F.col("_v") <= F.col(f"_hi{i}"))
            sums += [F.count_if(F.col("_v") < F.col(f"_lo{i}")).alias(f"_b{i}"), F.count_if(inside).alias(f"_in{i}"), grid(F.when(inside, F.col("_v"))).alias(f"_g{i}"), F.first(f"_lo{i}").alias(f"_lo{i}"), F.first(f"_hi{i}").alias(f"_hi{i}")]
        counted = joined(state).groupBy(*keys).agg(*sums)
        ends = []
        for i, n in enumerate(names):
            a, b = _bracket(F.col(f"_g{i}"), F.col(f"_b{i}"), F.col(f"_in{i}"), *ranks[n], F.col(f"_lo{i}"), F.col(f"_hi{i}"))
            ends += [a.alias(f"_lo{i}"), b.alias(f"_hi{i}")]
        state = counted.select(*keys, "_n", *ends)

    # values before a bracket count as one null, those after it go
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.when(F.col("_v") >= F.col(f"_lo{i}"), F.col("_v")).alias("v"), (F.col("_v") <= F.col(f"_hi{i}")).alias("ok")) for i in range(len(names))])
    left = joined(state).select(*keys, "_n", F.inline(F.filter(each, lambda e: e.ok))).groupBy(*keys, "i", "v").agg(F.count("*").alias("c"), F.first("_n").alias("_n"))
    upto = F.sum("c").over(W.partitionBy(*keys, "i").orderBy(F.col("v").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0))
    exact = F.element_at(F.array(*[F.lit(float(probs[n])) for n in names]), F.col("i") + 1) * (F.col("_n") - 1)
    found = left.withColumn("_upto", upto).withColumn("_p", exact).groupBy(*keys, "i").agg(
        F.min(F.when(F.col("_upto") > F.floor("_p"), F.struct("_upto", "v"))).alias("a"), F.min(F.when(F.col("_upto") > F.ceil("_p"), F.struct("_upto", "v"))).alias("b"), F.first(F.col("_p") - F.floor("_p")).alias("f")
    )
    lost = F.raise_error(F.lit("a quantile lies outside of its bracket"))
    lower, upper = F.coalesce("a.v", lost), F.coalesce("b.v", lost)
    mixed = F.when((F.col("f") == 0) | lower.eqNullSafe(upper), lower).otherwise((1 - F.col("f")) * lower + F.col("f") * upper)
    return found.select(*keys, "i", mixed.alias("_q")).groupBy(*keys).agg(*[F.max(F.when(F.col("i") == i, F.col("_q"))).alias(n) for i, n in enumerate(names)])

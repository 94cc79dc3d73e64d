"""Kennard-Stone selection for all groups at once: the farthest pair, then always the row farthest from those chosen."""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.functions.columns import doubles, guarded, half_even
from assayline.operators.order import ranked
from assayline.sources.shared import durable, release

_PART = 4096  # rows of a key that meet its numbers in one place
_PARTS, _CHUNKS, _ROUNDS, _MARKS = 12, 8, 8, 64  # a key's parts, its chunks for the first pair, its batches, the marks in a batch


def spread(few: DataFrame, rows: Column | str) -> DataFrame:
    """few, one row a key with its number of rows, once for each of the key's parts of _PART rows, so that a join by key and part spreads a large key over tasks."""
    return few.withColumn("_part", F.explode(F.sequence(F.lit(0), F.floor((F.col(rows) if isinstance(rows, str) else rows) / _PART).cast("int"))))


def part(place: str = "place") -> Column:
    """The part of a row by its place within its key."""
    return F.floor(F.col(place) / _PART).cast("int").alias("_part")


def standardised(rows: DataFrame, keys: Sequence[str], channels: int, *keep: str) -> DataFrame:
    """rows (keys, sample_id, x, keep...) with x scaled within each key: mean 0, population deviation 1, channels that don't vary 0; rows of another length or with non-finite values go. place and n: a row's place by sample_id and its key's rows."""
    keys = list(keys)
    able = rows.select(*keys, "sample_id", doubles(F.col("x")).alias("x"), *keep).where(f"size(x) = {channels} and forall(x, v -> v is not null and not isnan(v) and abs(v) < double('Infinity'))")
    each = able.select(*keys, F.posexplode("x").alias("_p", "_v")).groupBy(*keys, "_p").agg(F.avg("_v").alias("_m"), guarded(F.stddev_pop("_v")).alias("_s"), F.count("*").alias("_n"))
    sums = each.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_p", "_m", "_s"))).alias("_c"), F.first("_n").alias("_n"))
    placed = ranked(able, keys, ["sample_id"], "place", "n").withColumn("_part", part())
    scaled = F.zip_with("x", "_c", lambda v, c: (v - c["_m"]) / c["_s"]).alias("x")
    return placed.join(spread(sums, "_n"), [*keys, "_part"]).select(*keys, "sample_id", scaled, *keep, "place", "n")


def _matrix(rows: pa.Table) -> np.ndarray:
    return rows["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1) if len(rows) else np.zeros((0, 0))


def _exact(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of x's rows i to y's rows j to nine digits, some at a time."""
    return np.concatenate([np.zeros(0), *(np.round(np.sqrt(((x[i[at : at + 8192]] - y[j[at : at + 8192]]) ** 2).sum(1)), 9) for at in range(0, len(i), 8192))])


def _slack(x: np.ndarray, xx: np.ndarray, yy: float) -> np.ndarray:
    """More than what a squared distance made of a product of matrices errs by."""
    return 1e-15 * (x.shape[1] + 8) * (xx + yy)


def _shrink(x: np.ndarray, y: np.ndarray, least: np.ndarray, block: int = 512) -> None:
    """Lower x's least distances, in place, by those to y's rows.

    Squared distances by products of matrices tell which pairs may be a row's
    least; only those are measured by their differences.
    """
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    for a in range(0, len(x), block):
        p = slice(a, a + block)
        for b in range(0, len(y), block):
            q = slice(b, b + block)
            d = xx[p, None] + yy[None, q] - 2 * (x[p] @ y[q].T)
            slack = _slack(x, xx[p], yy[q].max())
            i, j = np.nonzero(d <= np.minimum(d.min(1) + 2 * slack, least[p] ** 2 + slack)[:, None])
            np.minimum.at(least[p], i, _exact(x[p], y[q], i, j))


def _farthest(x: np.ndarray, y: np.ndarray, ids: np.ndarray, others: np.ndarray, block: int = 512) -> tuple[float, int, int]:
    """(-distance, a, b) of the farthest pair of a row of x and one of y, of equal ones the least a, then b."""
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    best = (1.0, 0, 0)
    for a in range(0, len(x), block):
        p = slice(a, a + block)
        for b in range(0, len(y), block):
            q = slice(b, b + block)
            d = xx[p, None] + yy[None, q] - 2 * (x[p] @ y[q].T)
            slack = _slack(x, xx[p].max(), yy[q].max())
            top = max(float(d.max()), best[0] ** 2 if best[0] <= 0 else 0.0)
            i, j = np.nonzero(d >= top - 2 * slack - 4e-9 * (np.sqrt(max(top, 0.0)) + 1))  # what may be equal to nine digits
            if len(i):
                e = _exact(x[p], y[q], i, j)
                far = e == e.max()
                pairs = np.sort(np.stack([ids[p][i[far]], others[q][j[far]]], 1), axis=1)
                k = np.lexsort((pairs[:, 1], pairs[:, 0]))[0]
                best = min(best, (-float(e.max()), int(pairs[k, 0]), int(pairs[k, 1])))
    return best


def _first_pair(own: DataFrame, keys: list[str], kinds: str, tile: int) -> DataFrame:
    """(keys, a, b): each key's farthest pair, of equal ones the least a, then b, by sample_id; chunks of `tile` rows, or an eighth of the key if that is more, meet pairwise, and one row leaves a pair of chunks."""
    size = F.greatest(F.lit(tile), F.ceil(F.col("n") / _CHUNKS))
    chunked = own.withColumn("chunks", F.ceil(F.col("n") / size).cast("int")).withColumn("chunk", F.floor(F.col("place") / size).cast("int"))
    met = chunked.select(*keys, "sample_id", "x", "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    met = met.select(*keys, F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", F.col("sample_id").cast("bigint").alias("sample_id"), "x")

    def best(rows: pa.Table) -> pa.Table:
        ids, x, chunk = rows["sample_id"].to_numpy(), _matrix(rows), rows["chunk"].to_numpy()
        p, q = chunk == rows["low"][0].as_py(), chunk == rows["high"][0].as_py()
        d, a, b = _farthest(x[p], x[q], ids[p], ids[q])
        return rows.select(keys).slice(0, 1).append_column("d", pa.array([d])).append_column("a", pa.array([a])).append_column("b", pa.array([b]))

    pairs = met.groupBy(*keys, "low", "high").applyInArrow(best, kinds + "d double, a bigint, b bigint")
    return pairs.groupBy(*keys).agg(F.min(F.struct("d", "a", "b")).alias("m")).select(*keys, "m.a", "m.b")


def kennard_stone(rows: DataFrame, keys: Sequence[str], channels: int, ratio: float, batch: int = 256, tile: int = 1024) -> DataFrame:
    """(keys, sample_id, place): the rows that calibrate, in the order chosen from 0; of n rows half-even ratio * n, 2 at least and n - 1 at most.

    rows: keys, sample_id (whole numbers, unique within a key), x. Channels are standardised within each key.
    The first two are the farthest pair, the smaller sample_id first; then always
    the row whose least distance to those chosen is greatest, the smallest
    sample_id among equals (distances are rounded to nine digits). Keys of fewer
    than two usable rows give none; null keys too.

    Every key goes on at the same time, and each row keeps its least distance to
    those chosen. A round takes a batch of each key's rows, those of the greatest
    least distances down to a bound: as least distances only shrink, choices among
    the batch are right for as long as the best there isn't below the bound. All
    rows then learn of the round's choices at once, part by part.

    A batch has `batch` rows or an eighth of the key if that is more (and up to a fifth
    more, as its bound is found from some rows of each part), a part `tile`
    rows or a twelfth. So the number of rounds doesn't grow with the rows, and what
    is shuffled and written to the shared folder grows as the rows do: each round
    what is left of them, and the choices once a part. Comparisons stay
    quadratic in a key's rows, as the selection is; no matrix of distances is held.
    """
    keys = list(keys)
    scaled = standardised(rows.where(" and ".join(f"{k} is not null" for k in keys)), keys, channels)
    own = durable(scaled.where("n >= 2"))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in own.select(*keys).schema)
    want = F.least(F.greatest(F.lit(2), half_even(ratio * F.col("n"))), F.col("n") - 1)
    size = F.greatest(F.lit(tile), F.ceil(F.col("n") / _PARTS))
    some = F.greatest(F.lit(batch), F.ceil(F.col("n") / _ROUNDS))
    step = F.greatest(F.lit(1), F.floor(some / _MARKS))  # each step-th row of a part, by least distance, is a mark of the batch's end
    fixed = own.select(*keys, F.col("sample_id").cast("bigint").alias("sample_id"), "x", *[c.cast("int").alias(n) for n, c in {"want": want, "parts": F.ceil(F.col("n") / size), "step": step, "marks": F.ceil(some / step)}.items()], F.floor(F.col("place") / size).cast("int").alias("part"))
    settings = ["want", "parts", "step", "marks"]
    ints = ", ".join(f"{c} int" for c in settings)
    pair = _first_pair(own, keys, kinds, tile).select(*keys, F.posexplode(F.array("a", "b")).alias("place", "sample_id"))
    new = durable(pair.join(fixed, [*keys, "sample_id"]).where("place < want").select(*keys, "sample_id", F.col("place").cast("bigint").alias("place"), "x", *settings))
    state = fixed.withColumn("least", F.lit(float("inf")))

    def nearer(left: pa.Table, right: pa.Table) -> pa.Table:
        had = 1 + right["place"].to_numpy().max() if len(right) else 0
        if not len(left) or not len(right) or had >= left["want"][0].as_py():
            left, ids, least, order = left.slice(0, 0), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        else:
            left = left.filter(pa.array(~np.isin(left["sample_id"].to_numpy(), right["sample_id"].to_numpy())))
            ids, least = left["sample_id"].to_numpy(), left["least"].to_numpy().copy()
            _shrink(_matrix(left), _matrix(right), least)
            order = np.lexsort((ids, -least))
        at = np.empty(len(ids), np.int32)
        at[order] = np.arange(1, len(ids) + 1, dtype=np.int32)
        got = left.select([*keys, "sample_id", "x", *settings, "part"]).append_column("least", pa.array(least, pa.float64()))
        return got.append_column("had", pa.array(np.full(len(ids), had, np.int64))).append_column("at", pa.array(at))

    def pick(rows: pa.Table) -> pa.Table:
        order = np.lexsort((rows["sample_id"].to_numpy(), -rows["least"].to_numpy()))
        rows = rows.take(pa.array(order))
        ids, x, least = rows["sample_id"].to_numpy(), _matrix(rows), rows["least"].to_numpy().copy()
        bound, after, place, want = (rows[c][0].as_py() for c in ("bound", "after", "had", "want"))
        xx, picked = (x * x).sum(1), []
        slack = _slack(x, xx, xx.max())
        while place + len(picked) < want and len(picked) < len(ids):
            top = least.max()
            same = np.flatnonzero(least == top)
            i = int(same[ids[same].argmin()])
            if top < bound or (top == bound and ids[i] > after):
                break
            picked.append(i)
            close = np.flatnonzero((xx + xx[i] - 2 * (x @ x[i]) <= least * least + slack) & (least >= 0))
            least[close] = np.minimum(least[close], _exact(x, x, close, np.full(len(close), i)))
            least[i] = -1.0
        got = rows.select([*keys, "sample_id"]).take(pa.array(picked, pa.int64())).append_column("place", pa.array(np.arange(place, place + len(picked), dtype=np.int64)))
        for c in ("x", *settings):
            got = got.append_column(c, rows[c].take(pa.array(picked, pa.int64())))
        return got

    found = []
    while not new.isEmpty():
        found.append(new.select(*keys, "sample_id", "place"))
        told = new.select(*keys, "sample_id", "place", "x", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        last, state = state, durable(state.groupBy(*keys, "part").cogroup(told.groupBy(*keys, "part")).applyInArrow(nearer, f"{kinds}sample_id bigint, x array<double>, {ints}, part int, least double, had bigint, at int"))
        release(last)
        # the batch ends at its last mark, or with the last row where there are fewer; a mark further down a part can't be that
        marks = state.where("at % step = 0 and at <= step * marks").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct((-F.col("least")).alias("less"), "sample_id"))).alias("m"), F.first("marks").alias("marks"))
        limit = marks.select(*keys, F.get("m", F.col("marks") - 1).alias("m")).where("m is not null").select(*keys, (-F.col("m.less")).alias("bound"), F.col("m.sample_id").alias("after"))
        top = state.join(limit, keys, "left").withColumn("bound", F.coalesce("bound", F.lit(-1.0))).withColumn("after", F.coalesce("after", F.lit(-1)))
        top = top.where((F.col("least") > F.col("bound")) | ((F.col("least") == F.col("bound")) & (F.col("sample_id") <= F.col("after"))))
        new = durable(top.groupBy(*keys).applyInArrow(pick, f"{kinds}sample_id bigint, place bigint, x array<double>, {ints}"))
    if not found:
        return new.select(*keys, "sample_id", "place")
    return functools.reduce(DataFrame.unionByName, found)

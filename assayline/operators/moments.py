"""Cross-products of channels and response as one mergeable aggregate, and the models that follow from them alone."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.functions.columns import EPS, doubles

_BLOCK = 4096


def cross_products(rows: DataFrame, keys: Sequence[str], channels: int) -> DataFrame:
    """(keys, i, j, v): the sums of z_i z_j, i <= j, over each key's rows (keys, x, y), z = (1, x - x0, y - y0).

    x0 and y0, the means over all rows, come from a pass of their own and are
    broadcast (channels + 1 numbers), so that no digits are lost to a large mean.
    v of (0, 0) is the number of rows, (0, j) sums, the rest cross-products; they
    add up over any parts of the rows. Each task sums its rows in blocks, one
    product of matrices a key and block; only sums are shuffled, never spectra.
    Rows with a null key stay a group; rows with a null or non-finite value, or
    another number of channels, are left out. (i, j) = (-1, j) holds x0 and y0.
    """
    keys = list(keys)
    usable = rows.select(*keys, doubles(F.col("x")).alias("x"), F.col("y").cast("double").alias("y")).where(f"y is not null and not isnan(y) and abs(y) < double('Infinity') and size(x) = {channels} and forall(x, v -> v is not null and not isnan(v) and abs(v) < double('Infinity'))")
    means = usable.select(F.col("y"), *[F.get("x", i).alias(f"c{i}") for i in range(channels)]).agg(F.avg("y").alias("y"), *[F.avg(f"c{i}").alias(f"c{i}") for i in range(channels)]).first()
    if means["y"] is None:
        return usable.select(*keys).limit(0).select(*keys, F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0.0).alias("v"))
    shift = np.array([*(means[f"c{i}"] for i in range(channels)), means["y"]])
    size = channels + 2
    up, down = np.triu_indices(size)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in usable.select(*keys).schema) + (", " if keys else "")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, np.ndarray] = {}
        types = None
        for b in batches:
            types = [b.column(i).type for i in range(len(keys))]
            for a in range(0, len(b), _BLOCK):
                part = b.slice(a, _BLOCK)
                z = np.empty((len(part), size))
                z[:, 0] = 1
                z[:, 1:-1] = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(part), channels) - shift[:-1]
                z[:, -1] = part.column("y").to_numpy(zero_copy_only=False) - shift[-1]
                names = list(zip(*(part.column(i).to_pylist() for i in range(len(keys))), strict=True)) if keys else [()] * len(part)
                groups: dict[tuple, list[int]] = {}
                for at, name in enumerate(names):
                    groups.setdefault(name, []).append(at)
                for name, at in groups.items():
                    own = z[at]
                    totals[name] = totals.get(name, 0) + own.T @ own
                if len(totals) > 1000:  # bounded where keys are many; sums of a key add up later
                    yield lined(totals, types)
                    totals = {}
        if totals:
            yield lined(totals, types)

    def lined(totals: dict[tuple, np.ndarray], types: list[pa.DataType]) -> pa.RecordBatch:
        n = len(up)
        columns = [pa.array([name[i] for name in totals for _ in range(n)], t) for i, t in enumerate(types)]
        columns += [pa.array(np.tile(up, len(totals)).astype(np.int32)), pa.array(np.tile(down, len(totals)).astype(np.int32)), pa.array(np.concatenate([m[up, down] for m in totals.values()]))]
        return pa.RecordBatch.from_arrays(columns, [*keys, "i", "j", "v"])

    sums = usable.mapInArrow(summed, kinds + "i int, j int, v double").groupBy(*keys, "i", "j").agg(F.sum("v").alias("v"))
    origin = sums.select(*keys).distinct() if keys else sums.limit(1).select()
    origin = origin.select(*keys, F.lit(-1).alias("i"), F.posexplode(F.array(*[F.lit(float(v)) for v in shift])).alias("j", "v"))
    return sums.unionByName(origin.select(*keys, "i", (F.col("j") + 1).alias("j"), "v"))


class Gram:
    """A key's cross-products as a matrix, with what follows from them."""

    def __init__(self, z: np.ndarray, shift: np.ndarray):
        self.z, self.n, self.shift = z, z[0, 0], shift
        self.mean = z[0, 1:] / max(self.n, 1)
        self.s = z[1:, 1:] - self.n * np.outer(self.mean, self.mean)  # centred

    @classmethod
    def of(cls, i: np.ndarray, j: np.ndarray, v: np.ndarray) -> Gram:
        size = int(j.max()) + 1
        z = np.zeros((size, size))
        at = i >= 0
        z[i[at], j[at]] = v[at]
        z[j[at], i[at]] = v[at]
        shift = np.zeros(size)
        shift[j[~at]] = v[~at]
        return cls(z, shift[1:])

    def deviations(self, ddof: int) -> np.ndarray:
        """Standard deviations of channels and response, 1 for those below EPS."""
        d = np.sqrt(np.maximum(np.diag(self.s), 0) / max(self.n - ddof, 1))
        return np.where(d < EPS, 1.0, d)

    def squared_error(self, beta: np.ndarray, mean_x: np.ndarray, mean_y: float) -> float:
        """Sum of squared errors of mean_y + (x - mean_x) beta over these rows; means as differences from the shift."""
        own = np.append(-beta, 1.0)
        base = float(mean_y - mean_x @ beta)
        return float(own @ self.z[1:, 1:] @ own) - 2 * base * float(self.z[0, 1:] @ own) + self.n * base * base


def pls_coefficients(g: Gram, components: int) -> np.ndarray:
    """PLS1 coefficients on standardised channels (ddof 1), times the response's deviation, from cross-products alone.

    With S = X'X and c = X'y the weight of the next component is what is left of
    c, and scores enter only as r'S r, so no row is needed (Dayal and MacGregor, 1997).
    """
    d = g.deviations(1)
    s = g.s / np.outer(d, d)
    xx, c, sd = s[:-1, :-1], s[:-1, -1].copy(), d[-1]
    beta = np.zeros(len(c))
    loads, turns = [], []
    for _ in range(max(1, min(components, len(c), int(g.n) - 2))):
        size = np.linalg.norm(c)
        if size < EPS:
            break
        r = w = c / size
        for p, before in zip(loads, turns, strict=True):
            r = r - (p @ w) * before
        tt = float(r @ xx @ r)
        if tt < 1e-14:
            break
        p, q = xx @ r / tt, float(r @ c) / tt
        beta += q * r
        c = c - p * q * tt
        loads.append(p)
        turns.append(r)
    return beta * sd


def pls_scores(rows: DataFrame, keys: Sequence[str], channels: int, components: int) -> DataFrame:
    """(keys, pos, coef, corr) of rows (keys, x, y): each channel's PLS coefficient and absolute correlation; 0 where either doesn't vary."""
    keys = list(keys)
    sums = cross_products(rows, keys, channels)
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in sums.select(*keys).schema)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        g = Gram.of(pdf["i"].to_numpy(), pdf["j"].to_numpy(), pdf["v"].to_numpy())
        norm = np.sqrt(np.maximum(np.diag(g.s), 0))
        flat = (norm[:-1] <= EPS) | (norm[-1] <= EPS)
        corr = np.where(flat, 0.0, np.abs(g.s[:-1, -1]) / np.where(flat, 1.0, norm[:-1] * norm[-1]))
        out = pd.DataFrame({k: [pdf[k].iloc[0]] * len(corr) for k in keys} | {"pos": np.arange(len(corr), dtype=np.int32), "coef": pls_coefficients(g, components), "corr": corr})
        return out

    return sums.groupBy(*keys).applyInPandas(solve, kinds + "pos int, coef double, corr double")  # a matrix of channels a key


def ridge_folds(rows: DataFrame, keys: Sequence[str], fold: str, channels: int, penalties: Sequence[float]) -> DataFrame:
    """(keys, fold, idx, penalty, error): held-out root mean squared errors of ridge models for every fold and penalty.

    rows: keys, fold, x, y. One aggregate gives each fold's cross-products; a fold
    trains on the sum of all less its own, and its error follows from its own, so
    rows are read once however many folds and penalties there are. Channels are
    standardised (ddof 0) by the training part, the penalty is added to X'X as in
    the ridge kernel. A fold whose training part has fewer than two rows has error +inf.
    """
    keys = list(keys)
    sums = cross_products(rows, [*keys, fold], channels)
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in sums.select(*keys, fold).schema)
    values = np.asarray(penalties, float)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        folds = {name: Gram.of(p["i"].to_numpy(), p["j"].to_numpy(), p["v"].to_numpy()) for name, p in pdf.groupby(fold, sort=True)}
        whole = sum(g.z for g in folds.values())
        out = []
        for name, own in folds.items():
            g = Gram(whole - own.z, own.shift)
            errors = np.full(len(values), np.inf)
            if g.n >= 2:
                d = g.deviations(0)[:-1]
                lam, v = np.linalg.eigh(g.s[:-1, :-1] / np.outer(d, d))
                c = v.T @ (g.s[:-1, -1] / d)
                for i, a in enumerate(values):
                    left = lam + a
                    beta = v @ np.where(left > 1e-10 * max(lam.max(initial=0.0), 1.0), c / np.where(left == 0, 1, left), 0.0) / d
                    errors[i] = np.sqrt(max(own.squared_error(beta, g.mean[:-1], g.mean[-1]), 0.0) / own.n)
            out.append(pd.DataFrame({k: [pdf[k].iloc[0]] * len(values) for k in keys} | {fold: [name] * len(values), "idx": np.arange(len(values), dtype=np.int32), "penalty": values, "error": errors}))
        return pd.concat(out)

    return sums.groupBy(*keys).applyInPandas(solve, kinds + "idx int, penalty double, error double")  # a matrix of channels a key and fold


def ridge_coefficients(rows: DataFrame, keys: Sequence[str], channels: int, chosen: DataFrame) -> DataFrame:
    """(keys, pos, coef, intercept): the ridge model of all rows (keys, x, y) at each key's penalty (keys, penalty); coefficients on the channels as they are."""
    keys = list(keys)
    sums = cross_products(rows, keys, channels).join(F.broadcast(chosen.select(*keys, "penalty")), keys)  # one number a key
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in sums.select(*keys).schema)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        g = Gram.of(pdf["i"].to_numpy(), pdf["j"].to_numpy(), pdf["v"].to_numpy())
        d = g.deviations(0)[:-1]
        beta = np.linalg.lstsq(g.s[:-1, :-1] / np.outer(d, d) + pdf["penalty"].iloc[0] * np.eye(len(d)), g.s[:-1, -1] / d, rcond=None)[0] / d
        intercept = g.mean[-1] + g.shift[-1] - float((g.mean[:-1] + g.shift[:-1]) @ beta)
        return pd.DataFrame({k: [pdf[k].iloc[0]] * len(beta) for k in keys} | {"pos": np.arange(len(beta), dtype=np.int32), "coef": beta, "intercept": intercept})

    return sums.groupBy(*keys).applyInPandas(solve, kinds + "pos int, coef double, intercept double")

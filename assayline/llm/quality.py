"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.llm.common import durable

_BYTES = np.arange(256)
_IS = {
    "upper": (_BYTES >= 65) & (_BYTES <= 90),
    "lower": (_BYTES >= 97) & (_BYTES <= 122),
    "digit": (_BYTES >= 48) & (_BYTES <= 57),
    "stop": np.isin(_BYTES, list(b".,;:?")),
    "symbol": np.isin(_BYTES, list(b"!#$%&*+/<=>@[\\]^_`{|}~")),
    "space": np.isin(_BYTES, list(b" \t\n\r\x0b\x0c")),
    "high": _BYTES >= 128,
}
STATISTICS = ("words", "word_length", "upper", "digit", "stop", "symbol", "space", "high", "distinct", "top_word", "distinct_pairs", "repeated_lines", "line_words", "odd_words")


def statistics(text: bytes | None) -> np.ndarray:
    """The transformed statistics of one whole UTF-8 text; null and empty texts have all counts zero.

    Shares become logits with half an observation added on either side, counts
    logarithms, so that both are closer to normal within a class.
    """
    text = text or b""
    n = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    count = len(words)
    letters = int(n[_IS["upper"] | _IS["lower"] | _IS["high"]].sum())
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    pairs = len(set(zip(words, words[1:], strict=False)))
    odd = sum(1 for w, k in seen.items() for _ in range(k) if not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,;:?!")

    def share(k: float, of: float) -> float:
        return float(np.log((k + 0.5) / (of - k + 0.5)))

    size = len(text)
    of = {k: int(n[m].sum()) for k, m in _IS.items()}
    return np.array(
        [
            np.log1p(count), np.log1p(size / max(count, 1)), share(of["upper"], letters), share(of["digit"], size), share(of["stop"], size), share(of["symbol"], size), share(of["space"], size), share(of["high"], size),
            share(len(seen), count), share(max(seen.values(), default=0), count), share(pairs, max(count - 1, 0)), share(len(lines) - len(set(lines)), len(lines)), np.log1p(count / max(len(lines), 1)), share(odd, count),
        ]
    )


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x array<double>) for every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    schema = docs.select("doc_id", F.array(F.lit(0.0)).alias("x")).schema
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


@dataclass
class Discriminant:
    """Class log-densities by cached Cholesky factors: whiten[c] is the inverse of the lower factor."""

    prior: np.ndarray
    mean: list[np.ndarray]
    whiten: list[np.ndarray]
    log_det: list[float]

    @classmethod
    def fit(cls, n: np.ndarray, total: np.ndarray, outer: np.ndarray, pool: float, ridge: float) -> Discriminant:
        """From each class's row count, sum and sum of outer products.

        A class covariance is shrunk by `pool` towards the pooled one and then
        by `ridge` towards the pooled variances alone. A class without rows
        takes the pooled moments and a prior of half a row.
        """
        d = total.shape[1]
        all_n = max(n.sum(), 1)
        centre = total.sum(0) / all_n
        mean = [total[c] / n[c] if n[c] else centre for c in range(len(n))]
        scatter = [outer[c] - n[c] * np.outer(mean[c], mean[c]) for c in range(len(n))]
        pooled = sum(scatter) / all_n
        scale = np.diag(np.maximum(np.diag(pooled), 1e-6))
        whiten, log_det = [], []
        for c in range(len(n)):
            own = scatter[c] / n[c] if n[c] > d else pooled
            cov = (1 - pool) * own + pool * pooled
            factor = np.linalg.cholesky((1 - ridge) * cov + ridge * scale)
            whiten.append(np.linalg.inv(factor))
            log_det.append(2 * float(np.log(np.diag(factor)).sum()))
        prior = (n + 0.5) / (n.sum() + 0.5 * len(n))
        return cls(np.log(prior), mean, whiten, log_det)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 from the Mahalanobis log-density difference."""
        dens = [p - 0.5 * (((x - m) @ w.T) ** 2).sum(1) - 0.5 * k for p, m, w, k in zip(self.prior, self.mean, self.whiten, self.log_det, strict=True)]
        return 1 / (1 + np.exp(-np.clip(dens[1] - dens[0], -700, 700)))


def fit(labelled: DataFrame, pool: float = 0.1, ridge: float = 0.05) -> Discriminant:
    """Fit on all rows of labelled (x, label 0/1). Tasks send moments, 2 * (1 + d + d * d) numbers at most reach the driver."""
    d = len(STATISTICS)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for b in batches:
            if b.num_rows:
                x = b.column("x").flatten().to_numpy().reshape(-1, d)
                y = b.column("label").to_numpy()
                for c in (0, 1):
                    z = x[y == c]
                    total[c] += np.concatenate(([len(z)], z.sum(0), (z.T @ z).ravel()))
        c, i = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(c.ravel()), pa.array(i.ravel()), pa.array(total.ravel())], ["c", "i", "v"])

    sums = labelled.select("x", F.col("label").cast("bigint")).mapInArrow(moments, "c bigint, i bigint, v double").groupBy("c", "i").agg(F.sum("v").alias("v")).collect()
    got = np.zeros((2, 1 + d + d * d))
    for r in sums:
        got[r.c, r.i] = r.v
    return Discriminant.fit(got[:, 0], got[:, 1 : 1 + d], got[:, 1 + d :].reshape(2, d, d), pool, ridge)


def scores(docs: DataFrame, labels: DataFrame, learn: Column, threshold: float = 0.3, pool: float = 0.1, ridge: float = 0.05) -> DataFrame:
    """(doc_id, score, predicted) for every row of docs (doc_id, text).

    Learns from the rows of labels (doc_id, label) where `learn` (over doc_id)
    holds; a doc_id with several labels counts as 1 if any is 1, and null ids
    or labels are ignored. Each whole text is read once; its few statistics are
    kept in the shared folder. Null and empty texts get a score too. Without
    any learning rows both classes look alike and every score is 0.5.
    """
    found = durable(document_statistics(docs))
    truth = labels.where(learn & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.max("label").alias("label"))
    model = fit(found.join(truth, "doc_id"), pool, ridge)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(b.column("x").flatten().to_numpy().reshape(-1, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    schema = docs.select("doc_id", F.lit(0.5).alias("score"), F.lit(0).alias("predicted")).schema
    return found.mapInArrow(run, schema)

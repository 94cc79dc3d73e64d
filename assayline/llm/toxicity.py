"""Toxicity by nearest labelled examples: exact weighted TF-IDF cosine over all terms of the examples."""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.llm.common import durable

#: Bytes that end a word become spaces: all ASCII but digits and letters.
_SEPARATE = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
PREFIXES = (4,)
#: Places for the terms that no example has, by hash.
_OTHERS = 1 << 18


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().translate(_SEPARATE).split()


def terms(word: bytes) -> list[bytes]:
    """A word and its beginnings, by characters, which stand for its inflections."""
    if word.isascii():
        return [word] + [word[:n] + b"*" for n in PREFIXES if len(word) >= n]
    w = word.decode("utf-8", "replace")
    return [w.encode()] + [f"{w[:n]}*".encode() for n in PREFIXES if len(w) >= n]


Vector = tuple[np.ndarray, np.ndarray]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _alike(x: np.ndarray, size: int) -> np.ndarray:
    """An order of the rows of x in which blocks of `size` hold rows that lie close: halved by one column after the other."""
    todo, out = [(np.arange(len(x)), 0)], []
    while todo:
        rows, d = todo.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        rows = rows[np.argsort(x[rows, d % x.shape[1]], kind="stable")]
        cut = -(-len(rows) // (2 * size)) * size
        todo += [(rows[cut:], d + 1), (rows[:cut], d + 1)]
    return np.concatenate(out)


def _mixed(i: int, weights: np.ndarray) -> np.ndarray:
    """128 bits for each weight of example i, to nine digits."""
    x = np.round(weights * 1e9).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i * 0xC2B2AE3D27D4EB4F % (1 << 64))
    out = np.empty((len(x), 2), np.uint64)
    for k, (a, b) in enumerate(((0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53), (0xBF58476D1CE4E5B9, 0x94D049BB133111EB))):
        y = (x ^ (x >> np.uint64(31 + k))) * np.uint64(a)
        y = (y ^ (y >> np.uint64(29))) * np.uint64(b)
        out[:, k] = y ^ (y >> np.uint64(32))
    return out


@dataclass
class Index:
    """Unit TF-IDF vectors of the examples as a block-max inverted index.

    Examples stand in blocks of like ones. Rare terms have plain postings. A
    frequent term's postings are a column in each block's matrix, and its peak
    is the greatest weight that it has in the block: the rare terms' sum and
    the peaks bound every cosine of a block, so that blocks which can't hold
    one of the k nearest are passed over unread.

    Terms that occur equally often in the same examples, as a word and its
    beginnings often do, share one posting list: it holds weights without idf,
    and a text's terms of one list add theirs.

    idf: each term's weight, a share of its inverse document frequency; terms from
    the `known`-th on are those that no example has, which count in norms only.
    """

    idf: np.ndarray
    known: int
    ids: list
    toxic: np.ndarray
    weight: np.ndarray
    k: int = 16
    common: float = 0.08
    block: int = 64
    batch: int = 96
    postings: int = 2_000_000
    platt: tuple[float, float] = (1.0, 0.0)
    nothing: float = 0.0

    def unit(self, t: np.ndarray, tf: np.ndarray) -> np.ndarray:
        v = (1 + np.log(tf)) * self.idf[t]
        return v / np.sqrt((v * v).sum())

    def query(self, t: np.ndarray, tf: np.ndarray) -> Vector:
        """The examples' terms of a text and their weights, the whole text's norm being 1."""
        v, own = self.unit(t, tf), t < self.known
        return t[own], v[own]

    def add(self, vectors: Sequence[Vector]) -> None:
        """vectors: terms and weights of each example, in the order of ids; read one at a time, so that they need not be held."""
        n, terms_ = len(vectors), self.known
        mix = np.random.default_rng(0).standard_normal((terms_, 8), np.float32)
        near, times, sign = np.zeros((n, 8), np.float32), np.zeros(terms_, np.int64), np.zeros((terms_, 2), np.uint64)
        for i in range(n):
            t, v = vectors[i]
            times[t] += 1
            near[i] = v.astype(np.float32) @ mix[t]
            sign[t] += _mixed(i, v / self.idf[t])
        del mix
        # terms of one list have one sum of 128-bit hashes of their postings
        _, first, self.list = np.unique(np.column_stack((sign, times.astype(np.uint64))), axis=0, return_index=True, return_inverse=True)
        self.list = self.list.ravel().astype(np.int64)
        many, df = len(first), times[first]
        own_list = np.full(terms_, -1, np.int64)
        own_list[first] = np.arange(many)
        del sign, times
        self.example = _alike(near, self.block) if n else np.empty(0, np.int64)  # by slot
        frequent = df > self.common * n
        head = int(frequent.sum())
        self.column = np.full(many, -1, np.int32)
        self.column[frequent] = np.arange(head)
        blocks = -(-n // self.block)
        self.size = blocks * self.block
        matrix = np.zeros((self.size, head), np.float32)
        self.starts = np.append(0, np.cumsum(np.where(frequent, 0, df)))
        self.post, self.post_v = np.empty((self.starts[-1], 2), np.int32), np.empty(self.starts[-1])  # slot and weight side by side: one look-up
        self.head_rows = np.zeros(self.size + 1, np.int64)
        self.head_col, self.head_v = np.empty(df[frequent].sum(), np.int32), np.empty(df[frequent].sum())
        free, at = self.starts[:-1].copy(), 0
        for slot, i in enumerate(self.example.tolist()):
            t, v = vectors[i]
            v = v / self.idf[t]
            own = own_list[t] >= 0
            t, v = own_list[t[own]], v[own]
            c = self.column[t]
            own = c >= 0
            matrix[slot, c[own]] = v[own]
            to = at + int(own.sum())
            self.head_col[at:to], self.head_v[at:to] = c[own], v[own]
            self.head_rows[slot + 1 :] = at = to
            t, v = t[~own], v[~own]
            where = free[t]
            self.post[where, 0], self.post[where, 1], self.post_v[where] = slot, v.astype(np.float32).view(np.int32), v
            free[t] += 1
        self.matrix = matrix.reshape(blocks, self.block, head)
        self.peak = np.ascontiguousarray(self.matrix.max(axis=1).T) if n else np.zeros((0, 0), np.float32)

    def nearest(self, t: np.ndarray, v: np.ndarray, skip: int = -1) -> list[tuple[float, int]]:
        """The k examples of greatest cosine above zero, exactly; of equal ones those that come first."""
        return self.nearest_all([(t, v)], [skip])[0]

    def nearest_all(self, vectors: list[Vector], skips: list[int]) -> list[list[tuple[float, int]]]:
        """`nearest` of each vector, which `skips` keeps from one example each (-1: none).

        Frequent terms count in single precision first; what is not surely below
        the k-th counts again in double precision, and that decides.
        """
        slot = np.empty(len(self.example) + 1, np.int64)
        slot[self.example] = np.arange(len(self.example))
        slot[-1] = -1
        vectors = [self._listed(t, v) for t, v in vectors]
        out: list[list[tuple[float, int]]] = []
        at = held = 0
        for i, (t, _) in enumerate(vectors):  # long texts have many postings, so a batch ends by these too
            held += int((self.starts[t + 1] - self.starts[t]).sum())
            if i + 1 == len(vectors) or i + 1 - at == self.batch or held > self.postings:
                out += self._nearest(vectors[at : i + 1], slot[skips[at : i + 1]])
                at, held = i + 1, 0
        return out

    def _listed(self, t: np.ndarray, v: np.ndarray) -> Vector:
        """A text's posting lists and what its terms weigh there together."""
        lists, at = np.unique(self.list[t], return_inverse=True)
        return lists, np.bincount(at, v * self.idf[t], len(lists))

    def _nearest(self, vectors: list[Vector], skips: np.ndarray) -> list[list[tuple[float, int]]]:
        m, blocks, slack = len(vectors), len(self.matrix), 1e-5
        if not self.size:
            return [[] for _ in vectors]
        q, close, met = np.zeros((m, len(self.peak)), np.float32), np.empty((m, self.size), np.float32), []
        pairs = self.post.view(np.int64).ravel()
        for i, (t, v) in enumerate(vectors):
            c = self.column[t]
            frequent, rare = np.flatnonzero(c >= 0), np.flatnonzero(c < 0)
            q[i, c[frequent]] = v[frequent]
            first, w = self.starts[t[rare]], v[rare]
            size = self.starts[t[rare] + 1] - first
            where = _ranges(first, size)
            got = pairs[where].view(np.int32).reshape(-1, 2)
            to = got[:, 0].astype(np.intp)
            close[i] = np.bincount(to, got[:, 1].view(np.float32) * np.repeat(w.astype(np.float32), size), self.size)
            met.append((where.astype(np.int32), got[:, 0].copy(), np.cumsum(size), w, c[frequent], v[frequent]))
        out_of = np.flatnonzero(skips >= 0)
        close[out_of, skips[out_of]] = -2.0  # no frequent terms bring it above zero
        # weights are above zero, so the k-th of the rare terms' sums is a floor already
        bound = close.reshape(m, blocks, -1).max(axis=2) + q @ self.peak
        due = bound >= self._kth(close)[:, None] - slack
        if due.mean() > 0.6:
            close += q @ self.matrix.reshape(self.size, -1).T
        else:
            for j in np.flatnonzero(due.any(axis=0)):
                rows = np.flatnonzero(due[:, j])
                close[rows, j * self.block : (j + 1) * self.block] += q[rows] @ self.matrix[j].T
        out: list[list[tuple[float, int]]] = []
        part, place = np.zeros(len(self.peak)), np.full(self.size, -1, np.int32)
        for i, least in enumerate(self._kth(close)):
            found = np.flatnonzero(close[i] > max(least - slack, 0.0))
            where, to, ends, w, c, v = met[i]
            place[found] = np.arange(len(found))
            to = place[to]
            own = np.flatnonzero(to >= 0)
            exact = np.bincount(to[own], self.post_v[where[own]] * w[np.searchsorted(ends, own, "right")], len(found))
            place[found] = -1
            size = self.head_rows[found + 1] - self.head_rows[found]
            at = _ranges(self.head_rows[found], size)
            part[c] = v
            exact = exact + np.bincount(np.repeat(np.arange(len(found)), size), part[self.head_col[at]] * self.head_v[at], len(found))
            part[c] = 0.0
            exact, which = np.round(exact, 12), self.example[found]
            order = np.lexsort((which, -exact))[: self.k]
            out.append(list(zip(exact[order].tolist(), which[order].tolist(), strict=True)))
        return out

    def _kth(self, close: np.ndarray) -> np.ndarray:
        """Each row's k-th greatest cosine so far."""
        return np.partition(close, self.size - self.k, axis=1)[:, self.size - self.k] if self.size > self.k else np.zeros(len(close), np.float32)

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Log-odds of the distance-weighted votes, each for as many labelled rows as its example stands for."""
        votes = [0.0, 0.0]
        for c, i in near:
            votes[self.toxic[i]] += self.weight[i] * c / (1.05 - c)
        return float(np.log((votes[1] + 0.05) / (votes[0] + 0.05)))

    def score(self, near: list[tuple[float, int]]) -> float:
        if not near:
            return self.nothing
        a, b = self.platt
        return float(1 / (1 + np.exp(-np.clip(a * self.vote(near) + b, -500, 500))))

    def calibrate(self, votes: list[tuple[int, float | None]], blank: np.ndarray) -> None:
        """The Platt curve from (example, its leave-one-out vote); `blank` holds the weights of examples without terms, by class."""
        x, y, w = [], [], []
        for i, vote in votes:
            if vote is not None:
                x.append(vote)
                y.append(self.toxic[i])
                w.append(self.weight[i])
            else:
                blank[self.toxic[i]] += self.weight[i]
        self.nothing = float((blank[1] + 0.05) / (blank.sum() + 1.0))
        if not x:
            return
        x, y, w = np.array(x), np.array(y, float), np.array(w)
        n1, n0 = (w * y).sum(), (w * (1 - y)).sum()
        goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))  # Platt's targets
        a, b = 1.0, 0.0
        for _ in range(60):  # Newton steps with a slight pull of the slope to 1
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -50, 50)))
            g = np.array([(w * (p - goal) * x).sum() + (a - 1), (w * (p - goal)).sum() + 1e-3 * b])
            s = w * p * (1 - p)
            h = np.array([[(s * x * x).sum() + 1, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-3]])
            step = np.linalg.solve(h, g)
            a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -2, 2)
            if np.abs(step).max() < 1e-9:
                break
        self.platt = (max(a, 1e-3), b)


def _packed(t: np.ndarray, tf: np.ndarray) -> bytes:
    return zlib.compress(np.concatenate((np.diff(t, prepend=0), tf)).astype(np.int32).tobytes(), 1)


class _Unpacked(Sequence):
    """The unit vectors of packed counts, each made when asked for."""

    def __init__(self, index: Index, packed: list[bytes]) -> None:
        self.index, self.packed = index, packed

    def __len__(self) -> int:
        return len(self.packed)

    def __getitem__(self, i: int) -> Vector:
        steps, tf = np.frombuffer(zlib.decompress(self.packed[i]), np.int32).reshape(2, -1)
        t = np.cumsum(steps)
        return t, self.index.unit(t, tf)


def sample_examples(labels: DataFrame, learn: Column, per_class: int) -> DataFrame:
    """(doc_id, toxic, weight): at most per_class learning rows of each class, those of the least hash of the id."""
    truth = labels.where(learn & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r.toxic: r["count"] for r in truth.groupBy("toxic").count().collect()}
    parts = [truth.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).withColumn("weight", F.lit(max(1.0, n / per_class))) for c, n in sorted(sizes.items())]
    if not parts:
        return truth.withColumn("weight", F.lit(1.0))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return durable(out)


def example_texts(texts: DataFrame, examples: DataFrame) -> DataFrame:
    """(ids, toxic, weight, text): one row for each distinct text of texts (doc_id, text) and class that examples (doc_id, toxic, weight) give it.

    Copies are one example of their joint weight, and ids are theirs. As many rows at most as examples have texts.
    """
    joined = texts.join(F.broadcast(examples), "doc_id").withColumn("h", F.sha2("text", 256))
    return durable(joined.groupBy("h", "toxic").agg(F.sort_array(F.collect_list("doc_id")).alias("ids"), F.sum("weight").alias("weight"), F.first("text").alias("text")).drop("h"))


def weigh_terms(texts: DataFrame, z_full: float, odds_full: float, floor: float) -> tuple[list[bytes], np.ndarray]:
    """All terms of the examples (text, toxic), in order, and the weight of each: 1 for terms that go with a class
    surely, by |z| of the log-odds ratio of their counts over distinct texts, and strongly, by the ratio itself; less, but
    never below `floor`, for others, such as words of a language in which one class is merely more common."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own: dict[bytes, list[int]] = {b"": [0, 0]}
            for text, y in zip(b.column("text"), b.column("toxic").to_pylist(), strict=True):
                own[b""][y] += 1
                for t in {t for w in set(words(text.as_py())) for t in terms(w)}:
                    own.setdefault(t, [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()), *(pa.array([v[c] for v in own.values()], pa.int64()) for c in (0, 1))], ["term", "n0", "n1"])

    counts = texts.mapInArrow(count, "term binary, n0 bigint, n1 bigint").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow().sort_by("term")
    if not counts.num_rows or not (counts["n0"][0].as_py() and counts["n1"][0].as_py()):  # b"" comes first
        return [], np.empty(0)
    n0, n1 = (counts[n].to_numpy().astype(np.float64) for n in ("n0", "n1"))
    a, b, c, d = n1[1:] + 0.5, n0[1:] + 0.5, n1[0] + 0.5 - n1[1:], n0[0] + 0.5 - n0[1:]
    odds = np.abs(np.log(a * d / (b * c)))
    z = odds / np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return counts["term"][1:].to_pylist(), floor + (1 - floor) * np.minimum(z / z_full, 1) * np.minimum(odds / np.log(odds_full), 1)


class Reader(dict):
    """Gives a text's terms, in order, and how often each occurs in the whole text. Holds words' terms, as bytes.

    A term that no example has is named by its hash, beyond the known ones; such terms that share a place count as one.
    """

    def __init__(self, at: dict[bytes, int], most: int = 150_000) -> None:
        super().__init__()
        self.at, self.most = at, most

    def place(self, term: bytes) -> int:
        got = self.at.get(term)
        return len(self.at) + zlib.crc32(term) % _OTHERS if got is None else got

    def __missing__(self, w: bytes) -> bytes:
        if len(self) >= self.most:
            self.clear()
        got = self[w] = array("i", [self.place(t) for t in terms(w)]).tobytes()
        return got

    def read(self, text: bytes | None) -> Vector:
        bag = Counter(words(text))
        parts = list(map(self.__getitem__, bag))
        t = np.frombuffer(b"".join(parts), np.int32)
        if not len(t):
            return np.empty(0, np.int32), np.empty(0, np.int32)
        n = np.repeat(np.fromiter(bag.values(), np.int32, len(bag)), np.fromiter(map(len, parts), np.int64, len(parts)) // 4)
        order = np.argsort(t, kind="stable")
        t = t[order]
        new = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
        return t[new], np.add.reduceat(n[order], new).astype(np.int32)


def document_vectors(docs: DataFrame, at: Broadcast, carry: tuple[str, ...] = ()) -> DataFrame:
    """docs (doc_id, text binary, carry) with steps, the gaps between the places of a text's terms, and tf, their counts, in place of the text.

    Written out: each whole text is read once, and neither words nor the
    vocabulary are needed again. Carried columns don't go through Python.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        read = Reader(at.value).read
        for whole in batches:
            for start in range(0, len(whole), 512):
                got = [read(text.as_py()) for text in whole.slice(start, 512)]
                steps, tf = pa.array([np.diff(t, prepend=0).astype(np.int32).tobytes() for t, _ in got], pa.binary()), pa.array([n.tobytes() for _, n in got], pa.binary())
                yield pa.StructArray.from_arrays([steps, tf], ["steps", "tf"])

    # as good as random to the optimizer, which then computes it once for both fields
    vector = F.arrow_udf(run, "steps binary, tf binary").asNondeterministic()
    return durable(docs.select("doc_id", vector("text").alias("vector"), *carry).select("doc_id", "vector.steps", "vector.tf", *carry))


def _counts(steps: pa.Array, tf: pa.Array) -> list[Vector]:
    return [(np.cumsum(np.frombuffer(s.as_py(), np.int32)), np.frombuffer(n.as_py(), np.int32)) for s, n in zip(steps, tf, strict=True)]


def document_frequencies(vectors: DataFrame, many: int, piece: int = 8192) -> tuple[np.ndarray, int]:
    """In how many rows of vectors each of the `many` terms occurs, and the number of rows. A task's counts leave it in pieces."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(many + 1, np.int64)
        for b in batches:
            own[many] += b.num_rows
            for s in b.column("steps"):
                own[np.cumsum(np.frombuffer(s.as_py(), np.int32))] += 1
        if own[many]:
            cuts = range(0, many + 1, piece)
            yield pa.RecordBatch.from_arrays([pa.array(list(cuts), pa.int32()), pa.array([own[c : c + piece].tobytes() for c in cuts], pa.binary())], ["piece", "counts"])

    def total(t: pa.Table) -> pa.Table:
        own = sum(np.frombuffer(c.as_py(), np.int64) for c in t.column("counts"))
        return pa.table({"piece": t.column("piece")[:1].cast(pa.int32()), "counts": pa.array([own.tobytes()], pa.binary())})

    got = vectors.select("steps").mapInArrow(count, "piece int, counts binary").groupBy("piece").applyInArrow(total, "piece int, counts binary").collect()
    out = np.zeros(many + 1, np.int64)
    for r in got:
        own = np.frombuffer(r.counts, np.int64)
        out[r.piece : r.piece + len(own)] = own
    return out[:many], int(out[many])


def example_vectors(examples: DataFrame, at: Broadcast) -> list:
    """Rows of examples (ids, toxic, weight, text) as (ids, toxic, weight, t, tf)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader(at.value).read
        for b in batches:
            got = [read(text.as_py()) for text in b.column("text")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("ids", "toxic", "weight")), *(pa.array([g[c].tobytes() for g in got], pa.binary()) for c in (0, 1))], ["ids", "toxic", "weight", "t", "tf"])

    schema = examples.select("ids", "toxic", "weight", F.col("text").alias("t"), F.col("text").alias("tf")).schema
    rows = examples.select("ids", "toxic", "weight", "text").mapInArrow(run, schema).collect()
    return [(r.ids, r.toxic, r.weight, np.frombuffer(r.t, np.int32), np.frombuffer(r.tf, np.int32)) for r in rows]


def scores(docs: DataFrame, labels: DataFrame, learn: Column, threshold: float = 0.3, k: int = 16, per_class: int = 4096, z_full: float = 4.0, odds_full: float = 8.0, floor: float = 0.05, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, score, predicted, evidence) for every row of docs (doc_id, text).

    Examples: the distinct texts of at most `per_class` rows of each class of
    labels (doc_id, toxic) where `learn` holds, a bounded sample; a doc_id with
    several labels counts as toxic if any is 1, and each of its texts is an
    example. Terms: all words of the examples, and the beginnings of longer ones;
    terms that don't go with a class (|z| below z_full, odds ratio below
    odds_full either way) weigh less, at least `floor`, but none is left out.
    Words that no example has match nothing, but count in the length of a text's
    vector, with the weight `floor`, so that cosines are those of whole texts.
    Document frequencies are counted over all docs, those of such words by hash. Each document's k nearest examples
    by exact TF-IDF cosine vote by distance, each for the number of labelled
    rows it stands for; leave-one-out votes of the examples calibrate the score.
    evidence: [{example, cosine, toxic}], nearest first, where example is the
    smallest doc_id of the example's copies. A text without any term of the examples (null, empty
    or of other words only) gets the calibrated share of toxic rows among such.
    Without examples of both classes no term is weighed, so every text is of that
    kind. An example doesn't vote on its own document, unless copies of it with
    other ids are labelled so too. carry: further columns of docs to return with
    each row, of other names than these; text comes back as binary.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    examples = example_texts(texts, sample_examples(labels, learn, per_class))
    vocabulary, weights = weigh_terms(examples.select("text", "toxic"), z_full, odds_full, floor)
    at = context.broadcast({t: i for i, t in enumerate(vocabulary)})
    vectors = document_vectors(docs.select("doc_id", F.col("text").cast("binary").alias("text"), *[c for c in carry if c != "text"]), at, carry)
    df, n = document_frequencies(vectors, len(vocabulary) + _OTHERS)
    weights = np.concatenate((weights, np.full(_OTHERS, floor)))
    blank, used = np.zeros(2), []
    for ids, toxic, weight, t, tf in example_vectors(examples, at):
        if len(t) and t[0] < len(vocabulary):
            used.append((ids, toxic, weight, t, tf))
        else:
            blank[toxic] += weight
    used.sort(key=lambda u: (u[0], u[1]))
    index = Index(weights * (np.log((n + 1) / (df + 1)) + 1), len(vocabulary), [u[0] for u in used], np.array([u[1] for u in used], int), np.array([u[2] for u in used], float), k=k)
    # only counts are sent out, packed; each worker builds the index from them once
    shared = context.broadcast((index, [_packed(t, tf) for *_, t, tf in used]))

    def searched() -> tuple[Index, _Unpacked]:
        ix, packed = shared.value
        vectors = _Unpacked(ix, packed)
        if not hasattr(ix, "example"):
            ix.add(vectors)
        return ix, vectors

    def leave_one_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix, vectors = searched()
        for b in batches:
            own = b.column("id").to_pylist()
            near = ix.nearest_all([vectors[i] for i in own], own)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([ix.vote(x) if x else None for x in near], pa.float64())], ["id", "vote"])

    tasks = -(-len(used) // 512) or 1
    votes = spark.range(0, len(used), 1, tasks).mapInArrow(leave_one_out, "id bigint, vote double").collect()
    index.calibrate(sorted((r.id, r.vote) for r in votes), blank)
    platt, nothing = index.platt, index.nothing

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        ix, _ = searched()
        ix.platt, ix.nothing = platt, nothing
        own = {ids[0]: i for i, ids in enumerate(ix.ids) if len(ids) == 1}
        for whole in batches:
            for start in range(0, len(whole[0]), 512):
                doc_id, steps, tf = (c.slice(start, 512) for c in whole)
                got = _counts(steps, tf)
                some = [i for i, (t, _) in enumerate(got) if len(t) and t[0] < ix.known]
                skips = [own.get(d, -1) for d in doc_id.to_pylist()]
                near: list[list[tuple[float, int]]] = [[] for _ in got]
                for i, found in zip(some, ix.nearest_all([ix.query(*got[i]) for i in some], [skips[i] for i in some]), strict=True):
                    near[i] = found
                s = np.array([ix.score(x) for x in near], float)
                why = [[{"example": ix.ids[i][0], "cosine": c, "toxic": int(ix.toxic[i])} for c, i in x[:5]] for x in near]
                kind = pa.list_(pa.struct([("example", doc_id.type), ("cosine", pa.float64()), ("toxic", pa.int32())]))
                yield pa.StructArray.from_arrays([pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(why, kind)], ["score", "predicted", "evidence"])

    schema = f"score double, predicted int, evidence array<struct<example: {vectors.schema['doc_id'].dataType.simpleString()}, cosine: double, toxic: int>>"
    # nondeterministic only to the optimizer, so that filters on one field don't compute all again
    search = F.arrow_udf(run, schema).asNondeterministic()
    return vectors.select("doc_id", search("doc_id", "steps", "tf").alias("found"), *carry).select("doc_id", "found.score", "found.predicted", "found.evidence", *carry)

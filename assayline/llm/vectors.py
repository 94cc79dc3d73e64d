"""Embedding near-duplicates: sorted projection passes, then exact counts within the groups they find."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from assayline.llm.common import durable
from assayline.llm.components import connected_components

_STEP = 512
_PLANTED = 4096
_PASSES_AT_ONCE = 8


def _values(rows: DataFrame) -> Column:
    """The embedding in single precision if it is stored so, in double precision else."""
    kind = rows.schema["embedding"].dataType
    return F.col("embedding") if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else F.col("embedding").cast("array<double>")


def unit_vectors(rows: DataFrame) -> DataFrame:
    """(class_id, members, v): one row for each distinct usable vector of rows (vec_id, embedding).

    Vectors that are null, zero, or hold null or non-finite components are left
    out. Copies share a class; class_id is its smallest vec_id and members the
    number of rows.
    """
    usable = rows.select("vec_id", _values(rows).alias("v")).where("vec_id is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x != 0)")
    classes = usable.groupBy("v").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("members"))
    return classes.select("class_id", "members", "v")


class _Vectors:
    """Vectors of one width with their norms, and a test of pairs."""

    def __init__(self, column: pa.Array, threshold: float):
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        x = flat.reshape(len(column), -1)
        self.x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of tiny or huge components stay in range
        self.norm = np.sqrt((self.x * self.x).sum(axis=1))
        self.unit = (self.x / self.norm[:, None]).astype(np.float32)
        self.threshold, self.slack = threshold, max(1e-5, 1e-7 * x.shape[1])

    def pairs(self, a: np.ndarray, b: np.ndarray, upper: bool) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of places a and b (with upper, only those in which b's place in its list is beyond a's) at the threshold or above.

        Cosines in single precision decide but where they are close to the
        threshold; there double precision does.
        """
        cos = self.unit[a] @ self.unit[b].T
        near = cos >= self.threshold - self.slack
        if upper:
            near = np.triu(near, 1)
        r, c = np.nonzero(near)
        sure = cos[r, c] >= self.threshold + self.slack
        r, c = a[r], b[c]
        check = np.flatnonzero(~sure)
        for part in (check[k : k + 65536] for k in range(0, len(check), 65536)):
            p, q = r[part], c[part]
            sure[part] = np.einsum("ij,ij->i", self.x[p], self.x[q]) / (self.norm[p] * self.norm[q]) >= self.threshold
        return r[sure], c[sure]


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """root, where each place names the least of its group, after the groups of a[i] and b[i] became one for each i."""
    while True:
        x, y = root[a], root[b]
        new = x != y
        if not new.any():
            return root
        a, b, x, y = a[new], b[new], x[new], y[new]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up


@dataclass
class Pass:
    """Random directions, and a cut of each for every beginning of the bits before it."""

    directions: np.ndarray
    cuts: list[np.ndarray]
    known: int  # cuts depend on the first `known` bits at most

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """Each vector's bits, one for each direction, as a number: its place in the lexicographic order of the hashes."""
        code = np.zeros(len(unit), np.int64)
        for at, (side, cut) in enumerate(zip((unit @ self.directions.T).T, self.cuts, strict=True)):
            code = code * 2 + (side > cut[code >> max(0, at - self.known)])
        return code


def fit_pass(sample: np.ndarray, bits: int, rng: np.random.Generator) -> Pass:
    """A pass of `bits` hashes. Cuts are medians of the sample's vectors that share the bits before, so that dense regions are split like sparse ones."""
    known = max(0, int(np.log2(max(1, len(sample) / 16))))
    made = Pass(rng.normal(size=(bits, sample.shape[1])).astype(np.float32), [], known)
    code = np.zeros(len(sample), np.int64)
    for at, side in enumerate((sample @ made.directions.T).T):
        node = code >> max(0, at - known)
        size = np.bincount(node, minlength=2 ** min(at, known))
        middle = np.minimum(np.cumsum(size) - size + size // 2, len(sample) - 1)
        made.cuts.append(np.where(size > 0, side[np.lexsort((side, node))][middle], 0).astype(np.float32))
        code = code * 2 + (side > made.cuts[-1][node])
    return made


def plan_passes(sample: np.ndarray, n: int, threshold: float, recall: float, window: int, seed: int = 7) -> list[Pass]:
    """As many passes as n vectors like the sample's need.

    A partner at exactly the threshold is planted for sampled vectors. Passes are
    added until a share `recall` of these pairs agrees in all bits of some pass;
    so many bits leave about half a window of the n vectors, which all meet.
    """
    bits = max(1, int(np.ceil(np.log2(2 * n / window))))
    rng = np.random.default_rng(seed)
    x = sample[rng.permutation(len(sample))[:_PLANTED]]
    g = rng.normal(size=x.shape)
    g -= (g * x).sum(axis=1, keepdims=True) * x
    size = np.linalg.norm(g, axis=1, keepdims=True)
    y = np.where(size > 1e-9, threshold * x + np.sqrt(1 - threshold * threshold) * g / np.maximum(size, 1e-9), x).astype(np.float32)
    passes, met = [], np.zeros(len(x), bool)
    while met.mean() < recall:
        passes.append(fit_pass(sample, bits, rng))
        met |= passes[-1].codes(x) == passes[-1].codes(y)
    return passes


def _window_links(rows: DataFrame, keys: list[str], threshold: float, window: int) -> DataFrame:
    """(a, b): links that hold together what links within a window of the order by code, in each group of keys."""

    def compare(t: pa.Table) -> pa.Table:
        t = t.sort_by([("code", "ascending"), ("class_id", "ascending")])
        ids, vectors = t.column("class_id").to_numpy(), _Vectors(t.column("v").combine_chunks(), threshold)
        place, root = np.arange(len(ids)), np.arange(len(ids))
        for at in range(0, len(ids), _STEP):
            root = _join(root, *vectors.pairs(place[at : at + _STEP], place[at : at + _STEP + window], upper=True))
        some = root != place
        return pa.table({"a": ids[some], "b": ids[root[some]]})

    return rows.groupBy(*keys).applyInArrow(compare, "a bigint, b bigint")


def pass_links(units: DataFrame, threshold: float, window: int, recall: float, tile: int, sample: int) -> list[DataFrame]:
    """Links (a, b) of units (class_id, members, v), found by sorted projection passes over the vectors of each width.

    Up to `window` vectors lie in one window, all of whose pairs are compared.
    Of more, a sample of about `sample` vectors gives the passes (`plan_passes`).
    In each pass the vectors are ordered by their concatenated hashes, cut into
    ranges of about `tile` by the first bits, and each vector is compared with
    the `window` next ones. Ranges over four times as long are cut finer.
    """
    width = F.size("v")
    sizes = units.groupBy(width.alias("width")).count()
    few = units.join(sizes.where(F.col("count") <= window), width == F.col("width")).withColumn("code", F.lit(0))
    found = [durable(_window_links(few.select("width", "code", "class_id", "v"), ["width"], threshold, window))]
    for dim, n in sizes.where(F.col("count") > window).collect():
        own = units.where(width == dim)
        share = F.pmod(F.xxhash64("class_id", F.lit(1)), F.lit(1 << 30)) < int(min(1.0, sample / n) * (1 << 30))
        seen = own.where(share).select("class_id", "v").toArrow().sort_by("class_id")
        passes = plan_passes(_Vectors(seen.column("v").combine_chunks(), threshold).unit, n, threshold, recall, window)
        bits = len(passes[0].cuts)
        first = min(bits, max(0, int(np.ceil(np.log2(n / tile)))))
        model = units.sparkSession.sparkContext.broadcast(passes)

        def coded(batches, model=model):
            for b in batches:
                if b.num_rows:
                    unit = _Vectors(b.column("v"), threshold).unit
                    codes = np.stack([p.codes(unit) for p in model.value], axis=1)
                    yield pa.RecordBatch.from_arrays([b.column("class_id"), b.column("v"), pa.ListArray.from_arrays(np.arange(len(codes) + 1, dtype=np.int32) * codes.shape[1], codes.ravel())], ["class_id", "v", "codes"])

        kind = own.schema["v"].dataType.simpleString()
        codes = durable(own.select("class_id", "v").mapInArrow(coded, f"class_id bigint, v {kind}, codes array<bigint>"))
        for at in range(0, len(passes), _PASSES_AT_ONCE):
            each = codes.select("class_id", "v", F.posexplode(F.slice("codes", at + 1, _PASSES_AT_ONCE)).alias("pass", "code"))
            each = each.withColumn("range", F.shiftright("code", bits - first))
            long = durable(each.groupBy("pass", "range").count().where(F.col("count") > 4 * tile).select("pass", "range", F.lit(True).alias("long")))
            cut = each.join(long, ["pass", "range"], "left").withColumn("finer", F.when(F.col("long"), F.shiftright("code", max(0, bits - first - 6))))
            found.append(durable(_window_links(cut.select("pass", "range", "finer", "code", "class_id", "v"), ["pass", "range", "finer"], threshold, window)))
    return found


def count_links(units: DataFrame, groups: DataFrame, threshold: float, tile: int) -> DataFrame:
    """(class_id, others): with how many vectors of other classes of its group each class links.

    groups: class_id, component. Pairs within a group are compared and counted,
    none is returned. Groups of up to `tile` classes share tasks of some 2048 or
    more; larger ones are cut by hash into chunks of about `tile`, and a task
    takes a pair of chunks.
    """
    share = min(2048, tile)
    n = groups.count()
    sizes = groups.groupBy("component").agg(F.ceil(F.count("*") / tile).cast("int").alias("chunks"))
    rows = units.join(groups, "class_id").join(sizes, "component").withColumn("c", F.pmod(F.xxhash64("class_id"), F.col("chunks")).cast("int"))
    whole = F.col("chunks") == 1
    key = F.when(whole, F.pmod(F.xxhash64("component"), F.lit(max(1, -(-n // share))))).otherwise(F.col("component"))
    tiles = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tiles = tiles.select(F.size("v").alias("width"), whole.alias("whole"), key.alias("key"), F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c", "component", "class_id", "members", "v")

    def compare(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        i, j = key[3].as_py(), key[4].as_py()
        own, group, ids, members = (t.column(n).to_numpy() for n in ("c", "component", "class_id", "members"))
        vectors = _Vectors(t.column("v").combine_chunks(), threshold)
        others = np.zeros(len(ids), np.int64)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        for at in range(0, len(left), 2048):
            for to in range(at if i == j else 0, len(right), 2048):
                r, c = vectors.pairs(left[at : at + 2048], right[to : to + 2048], upper=i == j and at == to)
                same = group[r] == group[c]
                r, c = r[same], c[same]
                for one, other in ((r, c), (c, r)):
                    others += np.bincount(one, members[other], len(ids)).astype(np.int64)
        some = others > 0
        return pa.table({"class_id": ids[some], "others": others[some]})

    parts = tiles.groupBy("width", "whole", "key", "i", "j").applyInArrow(compare, "class_id bigint, others bigint")
    return parts.groupBy("class_id").agg(F.sum("others").alias("others"))


def near_duplicates(rows: DataFrame, threshold: float = 0.95, tile: int = 32_768, window: int = 1024, recall: float = 0.999, sample: int = 32_768) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of rows (vec_id, embedding).

    Sorted projection passes find links, connected components join them across
    passes, and links are then counted over all pairs within each component. A
    pair counts, for links and components alike, only at cosine >= threshold in
    double precision. Tables of up to `window` distinct vectors are compared
    whole. Beyond that the number of passes follows from the row count and the
    density: a pair just at the threshold that no other link joins is found with
    probability of about `recall` at least, closer ones more surely.

    Vectors that `unit_vectors` leaves out link with nothing. Rows that repeat a
    vec_id each get a row; rows with a null vec_id have no links, a null
    component and kept false. An empty table gives an empty result.
    """
    units = durable(unit_vectors(rows))
    found = pass_links(units, threshold, window, recall, tile, sample)
    links = found[0]
    for f in found[1:]:
        links = links.unionByName(f)
    groups = durable(connected_components(links).withColumnRenamed("node", "class_id"))
    linked = count_links(units, groups, threshold, tile)
    known = units.join(groups, "class_id", "left").join(linked, "class_id", "left").select("v", "members", F.coalesce("component", "class_id").alias("component"), F.coalesce("others", F.lit(0)).alias("others"))
    own = rows.select("vec_id", _values(rows).alias("v"))
    found = own.join(known, "v", "left").withColumn("usable", F.col("component").isNotNull() & F.col("vec_id").isNotNull())
    n_links = F.when(F.col("usable"), F.col("members") - 1 + F.col("others")).otherwise(0).cast("bigint")
    out = found.select("vec_id", n_links.alias("n_links"), F.when(F.col("usable"), F.col("component")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

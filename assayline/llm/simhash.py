"""SimHash near-duplicates: pigeonhole blocks over 64-bit fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.llm.common import durable
from assayline.llm.components import connected_components

BITS = 64


def fingerprint(text: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash of a text (UTF-8).

    A-Z are lower-cased and words are runs of bytes other than space and
    0x09-0x0D. Every shingle of `shingle` consecutive words, repeats included,
    votes with its XXH64; a bit is 1 if set in over half of them. Fewer words
    than a shingle count as one shingle; none at all give 0.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    first = np.concatenate(([0], ends[:-shingle])).tolist()
    last = (ends[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_digest
    n = len(first)
    votes = np.zeros(BITS, np.int64)
    for at in range(0, n, 65536):  # bounded memory for very long texts
        hashes = b"".join([digest(joined[a:b], seed) for a, b in zip(first[at : at + 65536], last[at : at + 65536], strict=True)])
        votes += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp bigint) for every row of docs (doc_id, text)."""
    schema = docs.select("doc_id").withColumn("fp", F.lit(0).cast("bigint")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle, seed) for t in b.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def _tables(blocks: int, distance: int) -> list[int]:
    """Bit masks, one for each way to choose the blocks that a close pair shares."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(masks, blocks - distance)]


def _star(fps: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Edges that join what is connected within one block, one for each member but the first.

    Each member popped is compared with those not reached yet, so a group in
    which all are close costs one pass, and memory is that of the block.
    """
    left, a, b = fps, [], []
    while len(left):
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            x = stack.pop()
            near = np.bitwise_count(left ^ x) <= distance
            if near.any():
                got = left[near]
                a += [x] * len(got)
                b += got.tolist()
                stack += list(got)
                left = left[~near]
    return a, b


def _block_edges(key: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified edges within the blocks of rows sorted by key."""
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.append(starts, len(key)))
    two = starts[sizes == 2]
    near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance
    a, b = [fp[two[near]]], [fp[two[near] + 1]]
    for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        x, y = _star(fp[s : s + n], distance)
        a.append(np.array(x, np.uint64))
        b.append(np.array(y, np.uint64))
    return np.concatenate(a), np.concatenate(b)


def links(fps: DataFrame, distance: int = 4, blocks: int = 7, tile: int = 8192) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints fps (fp) wherever a chain of close pairs does.

    Two fingerprints at `distance` or fewer differing bits agree in at least
    blocks - distance of the blocks; each such choice of blocks is a table, and
    the shared bits are the join key, so no close pair is lost. Seven blocks
    share three: 35 tables with keys of about 27 bits, which keeps chance
    company in a block small up to billions of texts. A block of more than
    `tile` fingerprints is cut by hash into chunks and every pair of chunks
    becomes a group of its own: no task holds more than 2 * tile of a block and
    no pair goes unseen. Verified edges leave as stars, never as all pairs.
    """
    masks = _tables(blocks, distance)
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fps = fps.repartition(tasks, "fp")  # a few bytes a row now, but 35 rows for each from here on
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(_long(m)).alias("bits")) for i, m in enumerate(masks)])).alias("k")).select("fp", F.xxhash64("k.t", "k.bits").alias("key"))
    hot = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > tile).select("key", F.ceil(F.col("n") / tile).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("chunks")).cast("int")
    tiled = keyed.join(hot, "key", "left").select(
        "fp",
        F.explode(
            F.when(F.col("chunks").isNull(), F.array("key")).otherwise(
                F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.xxhash64("key", F.least(j, chunk), F.greatest(j, chunk)))
            )
        ).alias("key"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = np.empty(0, np.int64)
        fp = np.empty(0, np.uint64)

        def out(k, f):
            a, b = _block_edges(k, f, distance)
            if len(a):
                pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
                a, b = pairs[:, 0].copy(), pairs[:, 1].copy()
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for x in batches:  # the last block may go on in the next batch
            key = np.concatenate((key, x.column("key").to_numpy(zero_copy_only=False)))
            fp = np.concatenate((fp, x.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)))
            if len(key) and (cut := int(np.searchsorted(key, key[-1]))):
                yield out(key[:cut], fp[:cut])
                key, fp = key[cut:], fp[cut:]
        if len(key):
            yield out(key, fp)

    return tiled.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "a bigint, b bigint")


def _long(u: int):
    return F.lit(u - (1 << 64) if u >= 1 << 63 else u).cast("bigint")


def near_duplicates(docs: DataFrame, distance: int = 4, blocks: int = 7, shingle: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs (doc_id, text).

    component_id is the smallest doc_id that links reach. Copies fold into one
    fingerprint before any join. A null or empty text has fingerprint 0 and is
    linked like any other; repeated rows each get a row; a null doc_id counts
    for nothing in the minimum, and a group of only null ids has none. An empty
    table gives an empty result.
    """
    own = durable(fingerprints(docs, shingle))
    return own.join(_components(own, "doc_id", distance, blocks), "fp").select("doc_id", "fp", F.col("least").alias("component_id"))


def _components(own: DataFrame, name: str, distance: int, blocks: int) -> DataFrame:
    """(fp, least) for each fingerprint of own (fp, name): the least name of its component.

    What is joined by component is written first, so that both sides of that
    join are plain shuffles and a large component can be split.
    """
    distinct = durable(own.groupBy("fp").agg(F.min(name).alias("least")))
    comps = connected_components(links(distinct.select("fp"), distance, blocks))
    rooted = durable(distinct.join(comps.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root")))
    ids = durable(rooted.groupBy("root").agg(F.min("least").alias("least")))
    return rooted.select("fp", "root").join(ids, "root").select("fp", "least")


def keep_one(docs: DataFrame, distance: int = 4, blocks: int = 7, shingle: int = 4) -> DataFrame:
    """One row of docs for each near-duplicate group of its rows, that of the smallest doc_id.

    Rows are told apart by doc_id and text: of several texts of the smallest
    doc_id within a group one stays, chosen by its hash, and a text of an id
    goes or stays whatever becomes of that id's other texts. Rows that repeat
    both are one. Rows with a null doc_id stay, as nothing can name them. An
    empty table gives an empty result; other columns come along whatever their
    names are.
    """
    th = F.xxhash64("text")
    named = docs.where("doc_id is not null").select(F.struct("doc_id", th.alias("th")).alias("doc_id"), "text")
    own = durable(fingerprints(named, shingle).withColumnRenamed("doc_id", "name"))
    kept = _components(own, "name", distance, blocks).select("least").distinct()
    counted = own.groupBy("name").agg(F.count("*").alias("n"), F.first("fp").alias("fp"))
    gone = counted.join(kept, counted.name == kept.least, "left_anti").select("name.doc_id", "name.th")
    again = counted.where("n > 1").join(kept, counted.name == kept.least, "left_semi").select("name.doc_id", "name.th")
    rows = docs.select("doc_id", th.alias("th"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).where("doc_id is not null")
    rows = rows.join(gone, ["doc_id", "th"], "left_anti")
    once = rows.join(again, ["doc_id", "th"], "left_anti").select("row.*")
    repeated = rows.join(again, ["doc_id", "th"], "left_semi").groupBy("doc_id", "th").agg(F.first("row").alias("row")).select("row.*")
    return once.unionByName(repeated).unionByName(docs.where("doc_id is null"))

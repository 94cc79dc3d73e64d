"""Substring deduplication: seed on winnowed anchors, extend, keep long repeats."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.llm.common import durable

#: Odd multipliers of the two rolling hashes.
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_BATCH_WORDS = 200_000


class _Powers:
    """Powers of an odd multiplier and of its inverse modulo 2**64, as long as the longest batch so far."""

    def __init__(self, m: int):
        self.pair = (m, pow(m, -1, 1 << 64))
        self.have = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.have[0]) < n:
            for i, m in enumerate(self.pair):
                steps = np.full(n, m, np.uint64)
                steps[0] = 1
                self.have[i] = np.cumprod(steps, dtype=np.uint64)
        return self.have[0][:n], self.have[1][:n]


_POWERS = [_Powers(m) for m in _MULTIPLIERS]


class _Rolling:
    """64-bit hashes of any sequences of consecutive word hashes x, from sums of powers modulo 2**64."""

    def __init__(self, x: np.ndarray, which: int):
        power, self.inverse = _POWERS[which](len(x) + 1)
        self.total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * power[: len(x)], dtype=np.uint64)))

    def __call__(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.total[end] - self.total[first]) * self.inverse[first]
        h ^= h >> np.uint64(31)
        h += (end - first).astype(np.uint64)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def _sliding(a: np.ndarray, width: int, best) -> np.ndarray:
    """best (minimum or maximum) over every `width` consecutive values."""
    size = 1
    while size * 2 <= width:
        a = best(a[:-size], a[size:])
        size *= 2
    return best(a[: -(width - size)], a[width - size :]) if size < width else a


class Passages:
    """The word hashes, windows and anchors of a few whole texts, side by side.

    A window is `window` consecutive words of one text, and its anchor the
    least hash among its `seed`-word sequences. The anchor depends on the
    window's words alone, so equal windows have equal anchors wherever they
    stand.
    """

    def __init__(self, texts: list[bytes], window: int, seed: int):
        words = [t.split() for t in texts]
        self.counts = np.fromiter(map(len, words), np.int64, len(words))
        self.first = np.cumsum(self.counts) - self.counts
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        n = len(self.doc)
        self.starts = np.empty(0, np.int64)
        self.anchor = np.empty(0, np.uint64)
        if n < window:
            return
        digest = xxhash.xxh3_128_digest
        self.hashes = np.frombuffer(b"".join([digest(w) for ws in words for w in ws]), np.uint64).reshape(-1, 2)
        at = np.arange(n - seed + 1)
        seeds = _Rolling(np.ascontiguousarray(self.hashes[:, 0]), 0)(at, at + seed)
        anchor = _sliding(seeds, window - seed + 1, np.minimum)
        end = (self.first + self.counts)[self.doc[: len(anchor)]]
        self.starts = np.flatnonzero(np.arange(len(anchor)) + window <= end)
        self.anchor = anchor[self.starts]
        self.window = window

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Each text's distinct anchors: (text number, hash)."""
        d, h = self.doc[self.starts], self.anchor
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        d, h = d[fresh], h[fresh]
        order = np.lexsort((h, d))
        d, h = d[order], h[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        return d[fresh], h[fresh]

    def spans(self, first: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        """128-bit hashes of the words from first to end, as two halves."""
        return [_Rolling(np.ascontiguousarray(self.hashes[:, i]), i)(first, end) for i in (0, 1)]

    def runs(self, shared: np.ndarray) -> tuple[np.ndarray, ...]:
        """The neighbouring windows around each occurrence of a shared anchor: (text number, first word, windows, anchor, hash halves of all their words)."""
        keep = np.isin(self.anchor, shared)
        at, anchor = self.starts[keep], self.anchor[keep]
        none = np.empty(0, np.int64)
        if not len(at):
            return (none,) * 6
        new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | (anchor[1:] != anchor[:-1]))))
        size = np.diff(np.append(new, len(at)))
        first = at[new]
        d = self.doc[first]
        return d, first - self.first[d], size, anchor[new], *self.spans(first, first + size - 1 + self.window)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches of about _BATCH_WORDS words, with their texts; a longer text stands alone."""
    for b in batches:
        text, at, size, held = b.column("text"), 0, 0, []
        for i in range(b.num_rows):
            t = text[i].as_py() or b""
            if held and size + len(t) > 6 * _BATCH_WORDS:
                yield b.slice(at, len(held)), held
                at, size, held = i, 0, []
            held.append(t)
            size += len(t)
        if held:
            yield b.slice(at, len(held)), held


def _longs(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64) if a.dtype == np.uint64 else a.astype(np.int64))


def _tag(text: bytes) -> int:
    """Tells apart rows of one doc_id with different texts."""
    return (zlib.crc32(text) & 0x7FFFFFFF) << 32


def repeated_windows(base: DataFrame, window: int, seed: int) -> DataFrame:
    """(doc_id, places array<struct<place, n, offsets>>): the windows of each document that also start in one of a smaller doc_id.

    base: doc_id (not null), text (binary). n windows from a place on, or those
    at the given offsets from it.

    Seeds: each document's anchors are grouped by hash, with minima kept
    map-side, and only those of two or more documents stay. Extension, both
    ways: the neighbouring windows that share an occurrence of a seed are one
    run, and the words under it one passage, hashed to 128 bits. Documents
    whose passage a smaller doc_id has too lose all of the run. Of each
    passage, its first document then stands for all: where a seed has several
    passages, their first documents' windows are compared one by one.

    So copies meet at the level of passages, about one row for a dozen words,
    and single windows are only made once for each different passage. All
    volumes follow the text; no pairs of documents are made, and a passage that
    a third of all documents share costs a row for each of its occurrences.
    """
    first_of = "struct<place:bigint,n:bigint,h1:bigint,h2:bigint>"

    def seeds(batches):
        for b, texts in _groups(batches):
            d, h = Passages(texts, window, seed).anchors()
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(d)), _longs(h)], ["doc_id", "seed"])

    def extend(batches):
        for b, texts in _groups(batches):
            shared = b.column("seeds").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            d, at, n, anchor, h1, h2 = Passages(texts, window, seed).runs(np.unique(shared))
            tags = np.array([_tag(t) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(d)), *map(_longs, (at + tags[d], n, anchor, h1, h2))], ["doc_id", "place", "n", "seed", "h1", "h2"])

    def compare(batches):
        for b, texts in _groups(batches):
            own = Passages(texts, window, seed)
            tags = np.array([_tag(t) for t in texts], np.int64)
            runs = b.column("runs")
            d = np.repeat(np.arange(len(texts)), np.diff(runs.offsets.to_numpy()))
            place, n, h1, h2 = (runs.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(4))
            ok = (place >> 32 << 32) == tags[d]
            d, place, n, h1, h2 = d[ok], place[ok], n[ok], h1[ok], h2[ok]
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(own.first[d] + (place & 0xFFFFFFFF), n) + offset
            w1, w2 = own.spans(at, at + window) if len(at) else (at, at)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(np.repeat(d, n))), *map(_longs, (np.repeat(h1, n), np.repeat(h2, n), offset, w1, w2))], ["doc_id", "h1", "h2", "offset", "w1", "w2"])

    passage = ["h1", "h2"]
    seeded = durable(base.select("doc_id", "text").mapInArrow(seeds, "doc_id bigint, seed bigint"))
    # what joins below is written first: both sides are plain shuffles then, and a common seed, window or passage can be split
    shared = durable(seeded.groupBy("seed").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("seed"))
    wanted = seeded.join(shared, "seed").groupBy("doc_id").agg(F.collect_set("seed").alias("seeds"))
    runs = durable(base.join(wanted, "doc_id").select("doc_id", "text", "seeds").mapInArrow(extend, "doc_id bigint, place bigint, n bigint, seed bigint, h1 bigint, h2 bigint"))

    firsts = durable(runs.groupBy(*passage).agg(F.min(F.struct("doc_id", "place", "n")).alias("f"), F.first("seed").alias("seed")))
    several = durable(firsts.groupBy("seed").agg(F.count("*").alias("passages")).where("passages > 1").select("seed"))
    by_doc = firsts.join(several, "seed").groupBy(F.col("f.doc_id").alias("doc_id")).agg(F.collect_list(F.struct("f.place", "f.n", *passage)).cast(f"array<{first_of}>").alias("runs"))
    windows = durable(base.join(by_doc, "doc_id").select("doc_id", "text", "runs").mapInArrow(compare, "doc_id bigint, h1 bigint, h2 bigint, offset bigint, w1 bigint, w2 bigint"))
    least = durable(windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("w1", "w2", "lo"))
    part = windows.join(least, ["w1", "w2"]).where("doc_id > lo").groupBy(*passage).agg(F.collect_set("offset").alias("offsets"))

    judged = durable(firsts.select(*passage, F.col("f.doc_id").alias("first")).join(part, passage, "left"))
    found = runs.join(judged, passage).where("doc_id > first or offsets is not null")
    offsets = F.when(F.col("doc_id") == F.col("first"), F.col("offsets"))
    return found.groupBy("doc_id").agg(F.collect_set(F.struct("place", "n", offsets.alias("offsets"))).alias("places"))


def _kept(text: bytes, places: list[dict] | None, window: int) -> tuple[int, list[bytes], list[tuple[int, int]]]:
    """Number of words, the words kept, and the maximal removed spans [first, end)."""
    words = text.split()
    tag = _tag(text)
    own = [p for p in places or [] if p["place"] >> 32 << 32 == tag]
    if not own:
        return len(words), words, []
    starts = [np.arange(p["n"]) if p["offsets"] is None else np.array(p["offsets"], np.int64) for p in own]
    at = np.unique(np.concatenate([s + (p["place"] & 0xFFFFFFFF) for s, p in zip(starts, own, strict=True)]))
    new = np.flatnonzero(np.concatenate(([True], at[1:] > at[:-1] + window)))
    spans = list(zip(at[new].tolist(), (at[np.append(new[1:], len(at)) - 1] + window).tolist(), strict=True))
    kept, done = [], 0
    for a, b in spans:
        kept += words[done:a]
        done = b
    return len(words), kept + words[done:], spans


def remove_repeats(docs: DataFrame, window: int = 50, seed: int = 25, carry: list[str] | None = None) -> DataFrame:
    """Cut from each text of docs (doc_id bigint, text) the passages that a smaller doc_id has too.

    Words are runs of bytes other than space and 0x09-0x0D. A word goes if a
    window of `window` consecutive words covers it whose sequence also starts
    in a document of a smaller doc_id, judged on the input. Returns doc_id,
    n_words, n_removed, kept_sha256 (of the kept words joined by one space),
    text (those words; the text as it was, null included, if nothing goes) and
    spans, the maximal repeats removed as [first word, end). Texts that are
    null, empty or shorter than a window lose nothing; repeated rows each get
    their row and do not remove one another's words; rows with a null doc_id
    neither lose nor cause anything. carry: further columns of docs to return,
    of other names than these; others can come along in a struct.
    """
    if taken := {"doc_id", "n_words", "n_removed", "kept_sha256", "text", "spans"}.intersection(carry or []):
        raise ValueError(f"columns {sorted(taken)} are results of their own; carry them in a struct")
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.struct(*[F.col(c) for c in carry or []] or [F.lit(0).alias("none")]).alias("carried"))
    base = rows.where("doc_id is not null")
    places = repeated_windows(base, window, seed)
    none = F.lit(None).cast("array<struct<place:bigint,n:bigint,offsets:array<bigint>>>")
    joined = base.join(places, "doc_id", "left").select("doc_id", "text", "carried", "places")
    joined = joined.unionByName(rows.where("doc_id is null").withColumn("places", none))
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, text string, spans array<struct<first:bigint,end:bigint>>, carried " + rows.schema["carried"].dataType.simpleString()

    def cut(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                out: list[tuple] = []
                for i in range(part.num_rows):
                    text, p = part.column("text")[i].as_py(), part.column("places")[i]
                    n, kept, spans = _kept(text or b"", p.as_py(), window)
                    joined = b" ".join(kept)
                    left = (text if not spans else joined) if text is not None else None
                    out.append((n, n - len(kept), hashlib.sha256(joined).hexdigest(), left and left.decode("utf-8", "replace") if left != b"" else "", [{"first": x, "end": y} for x, y in spans]))
                cols = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), part.column("carried")], ["doc_id", "n_words", "n_removed", "kept_sha256", "text", "spans", "carried"])

    return joined.mapInArrow(cut, schema).select("doc_id", "n_words", "n_removed", "kept_sha256", "text", "spans", *[F.col("carried")[c].alias(c) for c in carry or []])

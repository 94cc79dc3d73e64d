"""Periodic runs of words: equal-factor classes refined by length, squares merged into runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


_WORDS_AT_ONCE = 1 << 20
_LONG = 2048  # texts of so many words go together, as the lengths to refine follow the longest
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... of size[i] numbers each, one after another."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


class _Classes:
    """Classes of positions whose factors of one length are equal.

    `seats` holds the members of each class next to each other, so that those of
    any class can be listed at the cost of their number; `next` and `prev` link
    them in order of position. When a position's next member changes or its class
    goes, the gap that ends is looked at once: if it equalled the factor length at
    some time while it stood, a square began there.
    """

    def __init__(self, key: np.ndarray, live: np.ndarray):
        n = len(key)
        at = np.flatnonzero(live)
        at = at[np.argsort(key[at], kind="stable")]
        self.of = np.where(live, key, -1)
        self.next, self.prev = np.full(n, -1), np.full(n, -1)
        same = key[at[1:]] == key[at[:-1]]
        self.next[at[:-1][same]], self.prev[at[1:][same]] = at[1:][same], at[:-1][same]
        self.since = np.ones(n, np.int64)
        self.found: list[np.ndarray] = []
        self.seats, self.seat = at, np.full(n, -1)
        self.seat[at] = np.arange(len(at))
        self.size = np.bincount(key[at], minlength=2 * n + 1)  # a split gives its parts new names, and each position ends in one
        self.start = np.cumsum(self.size) - self.size
        self.classes = int(key[at].max(initial=-1)) + 1
        self.mark = np.zeros(n + 1, bool)  # its last place, which -1 names, is never set

    def members(self, classes: np.ndarray) -> np.ndarray:
        return self.seats[_ranges(self.start[classes], self.size[classes])]

    def settle(self, at: np.ndarray, length: int) -> None:
        """Note the squares among gaps that stood up to, but not at, this length."""
        gap = self.next[at] - at
        ok = (gap >= self.since[at]) & (gap < length)  # a missing next makes the gap negative
        self.found.append(np.stack([at[ok], gap[ok]]))

    def unlink(self, at: np.ndarray, length: int) -> None:
        """Take positions, sorted, out of their lists; what stands around them closes up."""
        self.mark[at] = True
        before, after = self.prev[at], self.next[at]
        left = before[(before >= 0) & ~self.mark[before]]
        self.settle(np.concatenate((at, left)), length)
        # stretches of neighbours that all go: the first's former and the last's next member meet
        first, last = at[~self.mark[before]], at[~self.mark[after]]
        left = self.prev[first[np.argsort(self.of[first], kind="stable")]]
        right = self.next[last[np.argsort(self.of[last], kind="stable")]]
        self.mark[at] = False
        self.next[left[left >= 0]], self.prev[right[right >= 0]] = right[left >= 0], left[right >= 0]
        self.since[left[left >= 0]] = length
        self.next[at] = self.prev[at] = -1

    def carve(self, at: np.ndarray) -> np.ndarray:
        """Move positions, grouped by class, to the last seats of their classes, which shrink; gives their new seats."""
        old = self.of[at]
        head = np.flatnonzero(np.concatenate(([True], old[1:] != old[:-1])))
        names, count = old[head], np.diff(np.append(head, len(at)))
        seats = _ranges(self.start[names] + self.size[names] - count, count)
        self.mark[at] = True
        stay = self.seats[seats]
        stay = stay[~self.mark[stay]]
        self.mark[at] = False
        tail = np.repeat(self.start[names] + self.size[names] - count, count)
        free = self.seat[at[self.seat[at] < tail]]  # as many in each class as those that must make room
        self.seats[free], self.seat[stay] = stay, free
        self.seats[seats], self.seat[at] = at, seats
        self.size[names] -= count
        return seats

    def retire(self, at: np.ndarray, length: int) -> None:
        if len(at):
            at = np.sort(at)
            self.unlink(at, length)
            self.carve(at[np.argsort(self.of[at], kind="stable")])
            self.of[at] = -1

    def split(self, moved: np.ndarray, label: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Part the positions of each class that have one label from the rest of it.

        Gives the classes that this touched, and of each split class all parts but
        the largest. A part that is the whole of its class stays as it is.
        """
        old = self.of[moved]
        order = np.lexsort((moved, label, old))
        moved, label, old = moved[order], label[order], old[order]
        head = np.concatenate(([True], (old[1:] != old[:-1]) | (label[1:] != label[:-1])))
        starts = np.flatnonzero(head)
        sizes = np.diff(np.append(starts, len(moved)))
        parts = sizes < self.size[old[starts]]
        keep = np.repeat(parts, sizes)
        moved, old, sizes = moved[keep], old[keep], sizes[parts]
        if not len(moved):
            return moved, moved
        self.unlink(np.sort(moved), length)
        seats = self.carve(moved)
        first = np.cumsum(sizes) - sizes
        made = np.arange(self.classes, self.classes + len(sizes))
        self.classes += len(sizes)
        self.start[made], self.size[made] = seats[first], sizes
        part = np.repeat(made, sizes)
        self.of[moved], self.since[moved] = part, length
        same = part[1:] == part[:-1]
        self.next[moved[:-1][same]], self.prev[moved[1:][same]] = moved[1:][same], moved[:-1][same]
        rests = np.unique(old)
        names, parents = np.concatenate((made, rests)), np.concatenate((old[first], rests))
        order = np.lexsort((names, -self.size[names], parents))
        largest = np.concatenate(([True], parents[order][1:] != parents[order][:-1]))
        return names, names[order][~largest]


def squares(key: np.ndarray, live: np.ndarray, longest: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, period) of the squares whose root is primitive, of at most `longest` words, and occurs `least` times or more.

    key: small numbers for the words of documents laid end to end, none shared by
    two documents; each document ends at a place that isn't live. Classes of
    factors of one length become those of the next length by splitting them by
    the classes that the last split made, but for the largest part of each
    (Crochemore, 1981): a position moves at most log n times. A class of fewer
    than `least` members is retired; what comes before a retired position or a
    document's end retires with the next length. Neighbouring members at a
    distance equal to the length are a square.
    """
    c = _Classes(key, live)
    every = np.arange(c.classes)
    gone = c.members(every[c.size[every] < least])
    c.retire(gone, 1)
    dead = np.concatenate((gone, np.flatnonzero(~live)))
    alive = every[c.size[every] > 0]
    splitters = c.members(alive[alive != np.argmax(c.size)])
    for length in range(2, longest + 1):
        if not len(splitters) and not len(dead):
            break
        out, moved = dead[dead > 0] - 1, splitters[splitters > 0] - 1
        out, moved = out[c.of[out] >= 0], moved[c.of[moved] >= 0]
        label = c.of[moved + 1].copy()
        touched = [c.of[out]]
        c.retire(out, length)
        small = np.empty(0, np.int64)
        if len(moved):
            names, small = c.split(moved, label, length)
            touched.append(names)
        names = np.unique(np.concatenate(touched))
        few = names[(c.size[names] < least) & (c.size[names] > 0)]
        gone = c.members(few)
        c.retire(gone, length)
        splitters = c.members(small)  # retired classes have no members left
        dead = np.concatenate((out, gone))
    c.settle(np.flatnonzero(c.of >= 0), longest + 1)
    found = np.concatenate(c.found, axis=1)
    return found[0], found[1]


def _merged(position: np.ndarray, period: np.ndarray, power: int, least: int) -> np.ndarray:
    """Rows (start, length, period), by start and period: squares of one period at consecutive positions are one run."""
    order = np.lexsort((position, period))
    position, period = position[order], period[order]
    head = np.flatnonzero(np.concatenate(([True], (period[1:] != period[:-1]) | (position[1:] != position[:-1] + 1)))) if len(position) else np.empty(0, np.int64)
    start, q = position[head], period[head]
    length = np.diff(np.append(head, len(position))) - 1 + 2 * q
    ok = length >= np.maximum(least, power * q)
    runs = np.stack([start[ok], length[ok], q[ok]], axis=1)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def find_runs(texts: list[list[bytes]], power: int = 4, least: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """All runs of several documents' words, each of its own: rows (start, length, period) in places of the words laid end to end with a gap after each document, and the places of the documents' first words."""
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(sizes + 1) - (sizes + 1)
    total = int((sizes + 1).sum())
    key, live = np.zeros(total, np.int64), np.zeros(total, bool)
    n = 0
    for at, words in zip(first.tolist(), texts, strict=True):
        ids: dict[bytes, int] = {}
        key[at : at + len(words)] = [ids.setdefault(w, len(ids)) for w in words]
        key[at : at + len(words)] += n
        live[at : at + len(words)] = True
        n += len(ids)
    position, period = squares(key, live, max(1, int(sizes.max(initial=0)) // power), power - 1)
    return _merged(position, period, power, least), first


def _collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words but those that a run has after its first period."""
    if not len(runs):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([w for w, n in zip(words, np.cumsum(edge).tolist(), strict=False) if n == 0])


def periodic_runs(docs: DataFrame, power: int = 4, least: int = 6) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for each row of docs (doc_id, text).

    Words are runs of characters other than space and 0x09-0x0D. A run is a
    longest stretch of words with smallest period q, `least` words and `power`
    periods long or longer; runs holds (start, length, period) by start, then
    period, starts counted from 0. collapsed is the text's words joined by single
    spaces without those that a run has after its first period. Null and empty
    texts have no words, no runs and an empty collapsed text; repeated rows and
    null ids each get their row; an empty table gives an empty result. There is no
    shuffle: a task takes whole texts, about two million words at a time or one
    longer text besides, and its memory follows that.
    """
    kind = docs.schema["doc_id"]
    schema = StructType([kind]).simpleString()[7:-1].replace(":", " ", 1) + ", n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary"

    def batch(ids: list[pa.Scalar], texts: list[list[bytes]], id_type: pa.DataType) -> pa.RecordBatch:
        runs, first = find_runs(texts, power, least)
        cuts = np.searchsorted(runs[:, 0], np.append(first, np.iinfo(np.int64).max))
        out = [runs[a:b] - [at, 0, 0] for a, b, at in zip(cuts, cuts[1:], first, strict=False)]
        flat = np.concatenate(out) if out else np.empty((0, 3), np.int64)
        listed = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(_RUN)))
        collapsed = pa.array([_collapsed(t, r) for t, r in zip(texts, out, strict=True)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array([len(t) for t in texts], pa.int64()), listed, collapsed], ["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, tuple[list, list]] = {}
        n = {False: 0, True: 0}
        id_type = None
        for b in batches:
            id_type = b.column("doc_id").type
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                words = (text.as_py() or b"").split()  # splits at exactly those bytes
                long = len(words) >= _LONG
                if n[long] and n[long] + len(words) > _WORDS_AT_ONCE:
                    yield batch(*held.pop(long), id_type)
                    n[long] = 0
                ids, texts = held.setdefault(long, ([], []))
                ids.append(doc)
                texts.append(words)
                n[long] += len(words) + 1
        for ids, texts in held.values():
            yield batch(ids, texts, id_type)

    return docs.selectExpr("doc_id", "cast(text as binary) as text").mapInArrow(run, schema)

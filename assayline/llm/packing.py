"""Best-two-fit packing of tokenized documents into fixed-length sequences."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.llm.common import durable

#: Words in which every normaliser of the vocabulary files agrees: ASCII and composed Latin letters.
_PLAIN = regex.compile(r"[\x21-\x7E¡-¬®-įı-ž]+")
_END = b"\xff"  # never in UTF-8; stands for the end-of-word suffix
_SUFFIX = "</w>"
_STOPS = ".,;:!?"
_ODD = frozenset("İŉſ")  # letters that normalisers treat on their own


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: character to byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordTokenizer:
    """Ids of whole texts under a vocabulary file whose merges stop at white space.

    The file's own library tokenizes words; each distinct word's ids are kept
    as little-endian unsigned 32-bit bytes, so that a text's ids are a join of
    its words' bytes. Plain words skip the library's text normalisation: their
    pieces go straight to a rank-based merge loop over the same merges, with
    the end-of-word suffix as a byte of its own. Files that aren't of this kind
    (no white-space-dropping split, no such suffix) are refused.
    """

    def __init__(self, path: str, remember: int = 150_000):
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        model, splits = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != _SUFFIX or splits[0]["behavior"] != "Removed" or not splits[0]["invert"]:
            raise ValueError(f"{path} doesn't drop white space between words")
        self.library = Tokenizer.from_file(path)
        self.pattern = regex.compile(splits[0]["pattern"]["Regex"])
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.words, self.pieces = _Memo(self._word, remember), _Memo(self._piece, remember)
        self._merge_table(model)

    def _merge_table(self, model: dict) -> None:
        import tiktoken

        alphabet = _byte_alphabet()

        def raw(token: str) -> bytes:
            ends = token.endswith(_SUFFIX)
            return bytes(alphabet[c] for c in (token[: -len(_SUFFIX)] if ends else token)) + _END * ends

        ids = {raw(t): i for t, i in model["vocab"].items() if t not in self.specials}
        order = [bytes([b]) for b in range(256)] + [bytes([b]) + _END for b in range(255)]
        order += [raw("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        ranks = {b: r for r, b in enumerate(dict.fromkeys(order))}
        self.rank_bytes = [np.array([max(ids.get(b, 0), 0)], "<u4").tobytes() for b in ranks]
        self.ranked = tiktoken.Encoding("ranked", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})

    def _piece(self, piece: str) -> bytes:
        return b"".join(map(self.rank_bytes.__getitem__, self.ranked._core_bpe.encode_single_piece(piece.encode() + _END)))

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        body = text[:-1] if text[-1] in _STOPS else text
        if body.isalpha() and max(body) <= "ž" and not _ODD.intersection(body):  # letters and at most one stop: the split is plain
            got = self.pieces[body.lower()] + (self.pieces[text[-1]] if body is not text else b"")
        elif _PLAIN.fullmatch(text) and not any(s in text for s in self.specials):
            got = b"".join([self.pieces[p] for p in self.pattern.findall(text.lower())])
        else:
            got = np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return got

    def ids(self, text: bytes) -> bytes:
        """The ids of a whole UTF-8 text as little-endian unsigned 32-bit bytes."""
        return b"".join(map(self.words.__getitem__, text.split()))


class _Memo(dict):
    """Values of a function, forgotten all at once when there are too many."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        got = self.make(key)
        if len(self) >= self.most:
            self.clear()
        self[key] = got
        return got


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenize(docs: DataFrame, vocabulary: str | None = None, limit: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row for each piece of docs (doc_id bigint, text): doc_id, piece, start, length, ids_crc32 (and ids).

    A document's ids are those of its whole text, then end_id. A null text
    counts as empty, so every row has at least one piece. Only documents of
    more than `limit` ids are cut, into pieces of `limit`. vocabulary: a path
    that every executor can read (None: the installed public file).
    """
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(vocabulary or default_vocabulary())
        tail = np.array([end_id], "<u4").tobytes()
        for b in batches:
            out: dict[str, list] = {"doc": [], "piece": [], "start": [], "length": [], "crc": [], "ids": []}
            for i, text in enumerate(b.column("text")):
                ids = t.ids(text.as_py() or b"") + tail
                for k, at in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[at : at + 4 * limit]
                    for name, v in zip(out, (i, k, at // 4, len(part) // 4, zlib.crc32(part), np.frombuffer(part, "<u4").astype(np.int64) if with_ids else None), strict=True):
                        out[name].append(v)
            cols = [b.column("doc_id").take(pa.array(out["doc"], pa.int64())), pa.array(out["piece"], pa.int32()), *(pa.array(out[c], pa.int64()) for c in ("start", "length", "crc"))]
            cols += [pa.array(out["ids"], pa.list_(pa.int64()))] * with_ids
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def best_two_fit(lengths: np.ndarray, limit: int) -> list[list[int]]:
    """Bins of item numbers with sum of lengths at most `limit` each; every item is in one bin.

    A bin takes the longest unpacked item that fits until none does. If a gap
    is left, the bin's smallest item gives way to two unpacked items that fill
    the gap it would leave more tightly than it did, the tightest pair there
    is. Unpacked lengths are bit sets, one ascending and one descending, so
    that the longest fit and the existence of a pair of a given sum are single
    operations on integers.
    """
    stacks: dict[int, list[int]] = {}
    for i in np.lexsort((-np.arange(len(lengths)), lengths)).tolist():
        stacks.setdefault(int(lengths[i]), []).append(i)
    up = sum(1 << n for n in stacks)
    down = sum(1 << (limit - n) for n in stacks)
    bins: list[list[int]] = []

    def take(n: int) -> int:
        nonlocal up, down
        i = stacks[n].pop()
        if not stacks[n]:
            up ^= 1 << n
            down ^= 1 << (limit - n)
        return i

    def give_back(n: int, i: int) -> None:
        nonlocal up, down
        if not stacks[n]:
            up |= 1 << n
            down |= 1 << (limit - n)
        stacks[n].append(i)

    while up:
        gap, held = limit, []
        while fits := up & ((1 << (gap + 1)) - 1):
            n = fits.bit_length() - 1
            held.append((n, take(n)))
            gap -= n
        if gap and len(held) > 1:
            small = held[-1][0]  # the longest fit comes first, so the last is the smallest
            for total in range(gap + small, small, -1):
                pairs = up & (down >> (limit - total))
                if total % 2 == 0 and pairs >> (total // 2) & 1 and len(stacks[total // 2]) < 2:
                    pairs ^= 1 << (total // 2)
                pairs &= ~1
                if pairs:
                    x = pairs.bit_length() - 1
                    old = held.pop()
                    held += [(x, take(x)), (total - x, take(total - x))]
                    give_back(*old)
                    break
        bins.append([i for _, i in held])
    return bins


def pack(docs: DataFrame, vocabulary: str | None = None, limit: int = 2048, end_id: int = 0, bins_per_task: int = 8192, rows_per_task: int = 500_000) -> DataFrame:
    """Pack all of docs (doc_id bigint, text) into sequences of at most `limit` ids.

    Returns one row for each piece of `tokenize` with sequence_id and offset,
    gapless from 0 within each sequence. Pieces are dealt evenly, copies too, to as
    many tasks as hold about bins_per_task sequences each, known from the sum of
    all lengths, and rows_per_task pieces at most; each task packs its own with
    `best_two_fit` and leaves at most a bin or so unfilled. Texts are tokenized
    once; only piece rows move. Empty tables give empty results, repeated rows are
    packed each for itself.
    """
    pieces = durable(tokenize(docs, vocabulary, limit, end_id))
    total, rows = pieces.agg(F.sum("length"), F.count("*")).first()
    tasks = max(1, -(-(total or 0) // (limit * bins_per_task)), -(-rows // rows_per_task))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts).combine_chunks()
        length = t.column("length").to_numpy()
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        own = TaskContext.get().partitionId() << 40
        for k, held in enumerate(best_two_fit(length, limit)):
            at = 0
            for i in held:
                sequence[i], offset[i] = own + k, at
                at += int(length[i])
        t = t.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
        yield from t.to_batches(max_chunksize=50_000)

    dealt = pieces.repartition(int(tasks)).sortWithinPartitions(*names)
    return dealt.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")

"""Benchmark decontamination by a prefix-filtered set join, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.llm.common import ascii_lower, durable

#: A word, after A-Z are lower-cased: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ said by what is in it, letters first, which takes fewer tests a character.
WORD = r"[a-z0-9\x{80}-\x{10FFFF}]+"
#: One word with what stands around it, A-Z not lower-cased yet.
_ONE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[a-zA-Z0-9\x{80}-\x{10FFFF}]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"


def word_array(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 0)


def word_count(text: Column) -> Column:
    """size(word_array(text)) without making the words: each becomes one character, and a text without words none."""
    t = F.coalesce(text, F.lit(""))
    left = F.regexp_replace(t, F.lit(_ONE), F.lit("w"))
    return F.when(t.rlike(_ONE), F.length(left)).otherwise(0).cast("bigint")


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id, n, words): the distinct windows of each item of items (item_id, text)."""
    w = items.where("item_id is not null").select("item_id", word_array(F.col("text")).alias("w")).where("size(w) > 0")
    n = F.least(F.lit(window), F.size("w"))
    return w.withColumn("n", n).select("item_id", "n", F.explode(F.expr("transform(sequence(0, size(w) - n), i -> slice(w, i + 1, n))")).alias("words")).distinct()


def _positions(docs: DataFrame, q: int) -> DataFrame:
    """(key columns, w, p, s): each place p (from 0) of each document's words w and the hash s of the q words there."""
    at = docs.select("doc_id", "th", F.col("w"), F.posexplode("w").alias("p", "first")).where(F.col("p") <= F.size("w") - q)
    return at.withColumn("s", F.xxhash64("first", *[F.get("w", F.col("p") + i) for i in range(1, q)]))


def hits(docs: DataFrame, windows: DataFrame, q: int, broadcast_rows: int) -> DataFrame:
    """(doc_id, th, item_id, start, n): where windows of at least q words occur in docs (doc_id, th, w).

    Shingles: one pass over all documents finds, word for word, every place of
    a shingle of q words that some window has. Rarity: those places are counted
    by shingle. Prefix: a window that occurs must bring all its shingles, so its
    rarest one (the prefix of a containment of 1) is necessary, and only that
    is joined. Position and length: the window starts as many words before the
    shingle as it stands in the window, at or after the document's first word.
    Verification: all its shingles stand one word apart from there on, so the
    document holds the window's words in order.
    """
    inner = f"transform(sequence(0, n - {q}), i -> struct(xxhash64({', '.join(f'words[i + {k}]' for k in range(q))}) as s, i as o, slice(words, i + 1, {q}) as ws))"
    windows = windows.withColumn("wid", F.array_join("words", " "))
    each = durable(windows.select("wid", "n", "words").distinct().select("wid", "n", F.inline(F.expr(inner))))
    known, at = each.select("s", "ws").distinct(), _positions(docs, q)
    # broadcast only if a count of it is within the bound; else both sides are shuffled, each place with its q words alone
    if each.count() <= broadcast_rows:
        known = F.broadcast(known)
        same = F.col("first") == F.get("ws", F.lit(0))
        for k in range(1, q):
            same = same & (F.get("w", F.col("p") + k) == F.get("ws", F.lit(k)))
    else:
        at, same = at.select("doc_id", "th", "p", "s", F.slice("w", F.col("p") + 1, q).alias("own")), F.col("own") == F.col("ws")
    places = durable(at.join(known, "s").where(same).select("doc_id", "th", "p", "s"))

    counts = places.groupBy("s").agg(F.count("*").alias("df"))
    rarest = each.join(counts, "s").groupBy("wid", "n").agg(F.min(F.struct("df", "s", "o")).alias("r"), F.count("*").alias("present"))
    # a window with a shingle that no document has can't occur
    prefix = durable(rarest.where(F.col("present") == F.col("n") - q + 1).select("wid", "n", F.col("r.s").alias("s"), F.col("r.o").alias("o")))  # so that a common shingle's places can be split in the join
    candidates = places.join(prefix, "s").select("doc_id", "th", "wid", "n", (F.col("p") - F.col("o")).alias("start")).where("start >= 0").distinct()
    due = candidates.join(each.select("wid", "s", "o"), "wid").select("doc_id", "th", "wid", "n", "start", "s", (F.col("start") + F.col("o")).alias("p"))
    there = places.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), F.col("p").alias("pp"), F.col("s").alias("ss")).distinct()
    met = due.join(there, due.doc_id.eqNullSafe(there.d) & (due.th == there.t) & (due.p == there.pp) & (due.s == there.ss))
    found = met.groupBy("doc_id", "th", "wid", "n", "start").agg(F.count("*").alias("k")).where(F.col("k") == F.col("n") - q + 1)
    return found.join(windows.select("wid", "item_id"), "wid").select("doc_id", "th", "item_id", "start", "n")


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, share: int = 20, q: int = 3, broadcast_rows: int = 200_000, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of docs (doc_id, text).

    A window is `window` consecutive words of an item of items (item_id, text),
    or the whole of a shorter one. A document's word is hit if some window's
    occurrence covers it; n_items counts the items with occurring windows. A
    document is contaminated if it has a hit and share * n_hit >= n_words. Null
    and empty texts have no words; items without words or with a null id match
    nothing; empty tables leave every document clean. Repeated rows, also
    those with a null doc_id, each get their row. carry: further columns of docs
    to return with each row, of other names than these.
    """
    th = F.xxhash64("text")  # tells apart rows of one doc_id with different texts
    split = docs.select("doc_id", th.alias("th"), word_array(F.col("text")).alias("w"))
    windows = durable(item_windows(items, window))
    lengths = {r.n for r in windows.select(F.least("n", F.lit(q)).alias("n")).distinct().collect()}  # q values at most
    rows = [hits(split, windows.where(F.least("n", F.lit(q)) == k), k, broadcast_rows) for k in sorted(lengths)]
    base = docs.select("doc_id", th.alias("th"), word_count(F.col("text")).alias("n_words"), F.struct(*carry or (F.lit(0).alias("none"),)).alias("carried"))
    if not rows:
        return _judged(base.withColumn("n_hit", F.lit(0).cast("bigint")).withColumn("items", F.array().cast("array<string>")), share, carry)
    all_hits = rows[0]
    for r in rows[1:]:
        all_hits = all_hits.unionByName(r)
    spans = all_hits.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.struct("start", "n"))).alias("spans"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("hit"), F.lit(0).alias("end")),
        lambda a, x: F.struct((a.hit + F.greatest(F.lit(0), x.start + x.n - F.greatest(x.start, a.end))).cast("int").alias("hit"), F.greatest(a.end, x.start + x.n).cast("int").alias("end")),
        lambda a: a.hit.cast("bigint"),
    )
    spans = spans.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), covered.alias("n_hit"), "items")
    joined = base.join(spans, base.doc_id.eqNullSafe(spans.d) & base.th.eqNullSafe(spans.t), "left")
    return _judged(joined.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), "carried"), share, carry)


def _judged(rows: DataFrame, share: int, carry: tuple[str, ...]) -> DataFrame:
    return rows.select(
        "doc_id", "n_words", F.col("n_hit").cast("bigint").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), *[F.col("carried")[c].alias(c) for c in carry],
    )

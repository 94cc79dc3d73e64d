"""Mixing sources to target weights: Sainte-Laguë quotas of equal blocks, for sources and then for their shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayline.llm.common import durable
from assayline.operators.order import ranked

_COPIES = 4096


def number_of(*parts: Column) -> Column:
    """60 bits of the MD5 of text columns joined by '|', as a non-negative bigint; null parts count as empty."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 15), 16, 10).cast("bigint")


def capped_shares(sources: DataFrame, total: float, most: int) -> DataFrame:
    """sources (size, weight, ...) with target: shares of total by weight, none above most * size.

    What a source can't take is shared among the others by weight until all fit.
    Every round is one aggregate; only two sums go to the driver.
    """
    room, weight = most * F.col("size"), F.col("weight")
    full = F.lit(0) == 1
    level, seen = 0.0, -1
    while True:
        got = sources.agg(F.coalesce(F.sum(F.when(full, room)), F.lit(0)).alias("room"), F.sum(F.when(~full, weight)).alias("weight"), F.count_if(full).alias("n")).first()
        if got.n == seen or not got.weight:
            level = level if got.weight else float("inf")
            break
        seen, level = got.n, (total - got.room) / got.weight
        full = room <= F.lit(level) * weight
    return sources.withColumn("target", F.least(room.cast("double"), F.lit(level) * weight))


def apportion(units: DataFrame, keys: Sequence[str], unit: str, quota: str) -> DataFrame:
    """units (keys, unit, votes, seats) with quota: the seats of each key's units by Sainte-Laguë.

    A key's `seats`, the same in all its rows, go to the highest of the quotients
    votes / 1, votes / 3, votes / 5 ..., the smaller unit among equals. With n
    units, V votes and S seats the quotient of the last seat lies between
    V / (2S + n) and V / (2S - n): rounding moves each unit's seats by a half at
    most. Seats above that bracket are counted, only the quotients within it,
    about two a unit, are ranked. Units without votes get none.
    """
    key = W.partitionBy(*keys) if keys else None
    sums = [F.sum("votes").alias("_v"), F.count_if(F.col("votes") > 0).alias("_n"), F.max("seats").alias("_s")]
    stats = units.groupBy(*keys).agg(*sums)
    able = units.where("votes > 0").join(stats, list(keys)) if keys else units.where("votes > 0").crossJoin(F.broadcast(stats))  # one row
    v, half = F.col("votes").cast("double"), F.col("_n") / 2
    slack = 1e-9
    low, high = F.col("_v") / (F.col("_s") + half) * (1 - slack), F.col("_v") / (F.col("_s") - half) * (1 + slack)
    base = F.when(F.col("_s") > half, F.floor(v / high + 0.5)).otherwise(0).cast("bigint")
    able = durable(able.select(*keys, unit, "votes", "_s", base.alias("_base"), F.floor(v / low + 0.5).cast("bigint").alias("_top")))
    left = able.groupBy(*keys).agg((F.max("_s") - F.sum("_base")).alias("_left"))
    open_ = able.where("_top > _base").select(*keys, unit, F.explode(F.sequence(F.col("_base") + 1, F.col("_top"))).alias("_j"), "votes")
    open_ = open_.select(*keys, unit, "_j", (F.col("votes") / (2 * F.col("_j") - 1)).alias("_q"))
    placed = ranked(open_, keys, [F.desc("_q"), unit, "_j"], "_rank", "_of")
    placed = placed.join(left, list(keys)) if key is not None else placed.crossJoin(F.broadcast(left))  # one row
    more = placed.where("_rank < _left").groupBy(*keys, unit).agg(F.count("*").alias("_more"))
    out = able.select(*keys, unit, "_base").join(more, [*keys, unit], "left").select(*keys, unit, (F.col("_base") + F.coalesce("_more", F.lit(0))).alias(quota))
    return units.join(out, [*keys, unit], "left").withColumn(quota, F.coalesce(quota, F.lit(0)))


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = 2, block: int = 16, rows_per_shard: int = 4096, seed: int = 42) -> DataFrame:
    """(doc_id, source, size, source_size, target, spans, taken) for each row of docs (doc_id, text, source): which words a mix of sources takes.

    Words are runs of characters other than space and 0x09-0x0D; size is their
    number. Sources in order of code points, null last, have the weights in turn;
    targets are their shares of `share` times all words, none above `most` times
    the source's own. Blocks of `block` words are apportioned to sources by their
    targets, then to the shards of each source by their words. A shard is
    a hash range of about rows_per_shard documents, laid out as a ring of words in
    hash order. It gives as many blocks as its quota says, from a seeded one on
    and round again, `most` times its words at most: so the blocks of a mix are
    random documents, whole but at its ends. spans are (start, length) in words,
    taken their sum, `most` times size at the most.

    Null and empty texts have size 0 and no spans. Copies are counted before any
    shuffle by shard, and each takes its own place on the ring; null ids and null
    sources are like others. The result depends on the rows alone, not on
    their order or partitions. An empty table gives an empty result.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")
    sizes = durable(docs.select("doc_id", "source", size.alias("size"), number_of(F.lit(seed), F.col("doc_id"), F.md5(F.col("text").cast("binary"))).alias("h")))
    sources = sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    sources = ranked(sources, [], [F.col("source").asc_nulls_last()], "sid", "_all")
    sources = durable(sources.withColumn("weight", F.get(F.array(*[F.lit(int(w)) for w in weights]), (F.col("sid") % len(weights)).cast("int"))).drop("_all"))
    total = share * (sources.agg(F.sum("size").alias("n")).first().n or 0)
    shared = capped_shares(sources, total, most)
    seats = F.floor(F.lit(min(total, most * total / share if share else 0.0)) / block + 0.5).cast("bigint")
    shared = apportion(shared.withColumn("votes", F.col("target")).withColumn("seats", seats), [], "sid", "blocks").drop("votes", "seats")
    shared = durable(shared.select("sid", F.col("source").alias("_source"), F.col("size").alias("source_size"), "target", "blocks", F.greatest(F.lit(1), F.ceil(F.col("rows") / rows_per_shard)).cast("bigint").alias("shards")))

    groups = sizes.groupBy("source", "doc_id", "h", "size").agg(F.count("*").alias("copies"))
    dealt = groups.join(shared.select("sid", "_source", "shards"), F.col("source").eqNullSafe(F.col("_source"))).withColumn("shard", F.col("h") % F.col("shards"))
    words = F.col("copies") * F.col("size")
    laid = W.partitionBy("sid", "shard").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    dealt = durable(dealt.select("sid", "shard", "doc_id", "source", "size", "h", "copies", (F.sum(words).over(laid) - words).alias("before")))
    shards = dealt.groupBy("sid", "shard").agg(F.sum(words).alias("votes")).join(shared.select("sid", F.col("blocks").alias("seats"), "source_size", "target"), "sid")
    shards = apportion(shards, ["sid"], "shard", "quota")
    ring = F.col("votes")
    start = block * (number_of(F.lit(seed), F.col("sid"), F.col("shard")) % F.greatest(F.lit(1), F.ceil(ring / block)))
    shards = shards.select("sid", "shard", "source_size", "target", ring.alias("ring"), start.cast("bigint").alias("first"), F.least(F.col("quota") * block, most * ring).alias("given"))

    out = dealt.join(shards, ["sid", "shard"])
    few, many = out.where(F.col("copies") <= _COPIES), out.where(F.col("copies") > _COPIES)
    few = few.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
    many = many.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("copies") - 1) / _COPIES)))).repartition("sid", "h", "_chunk")
    many = many.withColumn("copy", F.explode(F.sequence(F.col("_chunk") * _COPIES, F.least(F.col("copies"), (F.col("_chunk") + 1) * _COPIES) - 1))).drop("_chunk")
    out = few.unionByName(many).withColumn("at", F.col("before") + F.col("copy") * F.col("size"))

    def piece(e: Column) -> Column:
        low = F.greatest(F.col("at") + e * F.col("ring"), F.col("first"))
        high = F.least(F.col("at") + e * F.col("ring") + F.col("size"), F.col("first") + F.col("given"))
        return F.struct((low - F.col("at") - e * F.col("ring")).alias("start"), (high - low).alias("length"))

    spans = F.filter(F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(most).cast("bigint")), piece), lambda s: s.length > 0)
    out = out.select("doc_id", "source", "size", "source_size", "target", spans.alias("spans"))
    return out.withColumn("taken", F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x.length))


def mixed_texts(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """(doc_id, text) of the pieces that `mix` takes of docs, whose doc_ids must be distinct and not null; words joined by one space."""
    pieces = mixed.where("taken > 0").select("doc_id", F.explode("spans").alias("s"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return docs.select("doc_id", "text").join(pieces, "doc_id").select("doc_id", F.array_join(F.slice(words, (F.col("s.start") + 1).cast("int"), F.col("s.length").cast("int")), " ").alias("text"))

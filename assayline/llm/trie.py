"""Conversation prefix tries by partition refinement: classes split turn by turn, singletons leave as chains, sums fold back."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.llm.common import durable
from assayline.operators.order import ranked

_FIRST, _MOST = 4, 64
_BIN = 2048
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, h, chars, n) of conversations (conv_id, turn, role, text): each turn's place from 0, digest and length in code points, and its conversation's turns.

    Turns are ordered by number, null first, equal ones by their digest: SHA-256
    of role and text, null counting as empty. Rows without a conv_id belong to no
    conversation. A conversation of any length is ranked over many tasks.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", digest.alias("h"), F.char_length(text).cast("bigint").alias("chars"))
    return ranked(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), "h"], "pos", "n").drop("turn")


def _refined(active: DataFrame, turns: DataFrame, depth: int, length: int) -> DataFrame:
    """(conv_id, n, entry, steps): the next `length` turns of each active conversation with what its classes have become.

    active: conv_id, n, label and entry, the class's name. A class is split by its
    members' turns, so its label is the digest of the former label and the turn; a
    step holds the class's size, its least conv_id, the turn's length and label.
    """
    own = turns.where((F.col("pos") >= depth) & (F.col("pos") < depth + length)).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "h", "chars"))).alias("t"))
    chained = F.aggregate(
        "t", F.struct(F.col("label"), F.array().cast("array<binary>").alias("all")),
        lambda s, t: F.struct(F.unhex(F.sha2(F.concat(s.label, t.h), 256)).alias("label"), F.concat(s["all"], F.array(F.unhex(F.sha2(F.concat(s.label, t.h), 256)))).alias("all")),
    )
    step = active.where(F.col("n") > depth).join(own, "conv_id").select("conv_id", "n", "entry", F.arrays_zip(chained["all"].alias("label"), F.col("t.chars").alias("chars")).alias("steps"))
    step = durable(step)
    each = step.select("conv_id", F.posexplode("steps").alias("j", "s")).select("conv_id", "j", "s.label", "s.chars")
    # written, so that both sides of the join are plain shuffles and a large class can be split
    classes = durable(each.groupBy("label").agg(F.count("*").alias("size"), F.min("conv_id").alias("least")))
    judged = each.join(classes, "label").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("j", "size", "least", "chars", "label"))).alias("steps"))
    return durable(step.select("conv_id", "n", "entry").join(judged, "conv_id"))


def _folded(nodes: DataFrame) -> DataFrame:
    """nodes (conv_id, depth, up, leaves, saved) with leaves and saved summed over each node's subtree.

    The ancestor 1, 2, 4, ... levels up is known for each node by doubling; it
    receives the sum of what the node has gathered so far, so that a trie of
    depth d takes log d rounds.
    """
    nodes = durable(nodes)
    deepest = nodes.agg(F.max("depth").alias("d")).first().d or 0
    step = 1
    while step <= deepest:
        below = nodes.where(F.col("depth") >= step)
        gift = below.groupBy(F.col("up").alias("conv_id"), (F.col("depth") - step).alias("depth")).agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
        out = nodes.join(gift, ["conv_id", "depth"], "left")
        above = nodes.where(F.col("depth") >= step).select(F.col("conv_id").alias("up"), F.col("depth").alias("_at"), F.col("up").alias("_next"))
        out = out.withColumn("_at", F.col("depth") - step).join(above, ["up", "_at"], "left")
        others = [c for c in nodes.columns if c not in ("conv_id", "depth", "up", "leaves", "saved")]
        nodes = durable(out.select("conv_id", "depth", F.col("_next").alias("up"), (F.col("leaves") + F.coalesce("_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("_saved", F.lit(0))).alias("saved"), *others))
        step *= 2
    return nodes


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trie of conversations by their first turns: its nodes and where each conversation ends.

    turns (conv_id, pos, h, chars) has each turn's place from 0 without gaps, a
    digest that names its role and text, and its length; conversations (conv_id, n)
    has each conversation once with its number of turns, 0 too.

    nodes: conv_id (the smallest member) and depth, which name a node and where its
    last turn stands, parent_conv_id (null for the root), n_convs, n_children,
    n_leaves, saved_tokens (over the subtree, members beyond the first times the
    last turn's length). ends: conv_id, end_conv_id and depth of the node at which it ends.

    All conversations are one class at first. A round splits the classes by their
    members' next turns, 4 at first, then 8, up to 64; a conversation that
    is alone in a class leaves with its remaining turns as an unary chain, the
    others go on. So a round's rows are active conversations, of whose turns 64
    at most are in one row, and a long conversation or a large class is shared
    by many tasks. Counts and sums fold back over the nodes with two members or
    more. An empty table has no nodes.
    """
    conversations = durable(conversations.select("conv_id", F.col("n").cast("bigint").alias("n")))
    turns = durable(turns.select("conv_id", F.col("pos").cast("bigint").alias("pos"), "h", "chars"))
    root = conversations.agg(F.count("*").alias("n"), F.min("conv_id").alias("least")).first()
    kind = conversations.schema["conv_id"].dataType
    least = F.lit(root.least).cast(kind)
    first = conversations.limit(1).select(least.alias("conv_id"), F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast(kind).alias("up"), F.lit(root.n).cast("bigint").alias("n_convs"), F.lit(0).cast("bigint").alias("chars"))
    nodes, chains = [first], []
    ends = [conversations.where("n = 0").select("conv_id", least.alias("end_conv_id"), F.lit(0).cast("bigint").alias("depth"))]
    active = conversations.select("conv_id", "n", F.lit(b"").alias("label"), least.alias("entry")).where("n > 0")
    depth, length = 0, _FIRST
    while not active.isEmpty():
        got = _refined(active, turns, depth, length)
        at = F.posexplode("steps").alias("i", "s")
        each = got.select("conv_id", "entry", "steps", at).withColumn("up", F.when(F.col("i") == 0, F.col("entry")).otherwise(F.get("steps", F.col("i") - 1)["least"]))
        here = (F.lit(depth + 1) + F.col("i")).cast("bigint").alias("depth")
        nodes.append(each.where("s.size > 1 and s.least = conv_id").select("conv_id", here, "up", F.col("s.size").alias("n_convs"), "s.chars"))
        alone = F.array_position(F.transform("steps", lambda s: s.size), F.lit(1).cast("bigint"))
        chains.append(each.where(F.col("i") + 1 == alone).select("conv_id", here, "up"))
        last = F.element_at("steps", -1)
        ends.append(got.where((alone == 0) & (F.col("n") == depth + F.size("steps"))).select("conv_id", last["least"].alias("end_conv_id"), F.col("n").alias("depth")))
        active = got.where((alone == 0) & (F.col("n") > depth + length)).select("conv_id", "n", last["label"].alias("label"), last["least"].alias("entry"))
        depth, length = depth + length, min(2 * length, _MOST)

    upper = durable(reduce(DataFrame.unionByName, nodes))
    none = conversations.limit(0).select("conv_id", F.col("n").alias("depth"), F.col("conv_id").alias("up"))
    chains = durable(reduce(DataFrame.unionByName, chains, none))
    # children: nodes of several members, and the tops of chains
    kids = upper.where("depth > 0").select("up", "depth", F.lit(0).alias("single")).unionByName(chains.select("up", "depth", F.lit(1).alias("single")))
    kids = kids.groupBy(F.col("up").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"), F.sum("single").alias("singles"))
    upper = upper.join(kids, ["conv_id", "depth"], "left").select("conv_id", "depth", "up", F.col("up").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.when(F.col("n_children").isNull(), 1).otherwise(F.col("singles")).cast("bigint").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    inner = _folded(upper).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))

    tops = chains.join(conversations, "conv_id").select("conv_id", F.col("depth").alias("_top"), "up", "n")
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    tail = turns.select("conv_id", (F.col("pos") + 1).alias("depth")).join(tops, "conv_id").where("depth >= _top")
    tail = tail.select("conv_id", "depth", F.when(F.col("depth") == F.col("_top"), F.col("up")).otherwise(F.col("conv_id")).alias("parent_conv_id"), one.alias("n_convs"), F.when(F.col("depth") < F.col("n"), one).otherwise(zero).alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"))
    alone_ends = tops.select("conv_id", F.col("conv_id").alias("end_conv_id"), F.col("n").alias("depth"))
    return inner.unionByName(tail), reduce(DataFrame.unionByName, ends).unionByName(alone_ends)


def end_digests(ends: DataFrame) -> DataFrame:
    """(end_conv_id, depth, ends_sha256): SHA-256 of the conv_ids (integers) that end at each node of ends, ascending and joined by commas.

    Ids of one node are first joined within ranges of 2048 numbers, then the
    ranges are hashed one after another as they stream by, so no task holds a
    node's ids.
    """
    bins = ends.groupBy("end_conv_id", "depth", F.floor(F.col("conv_id") / _BIN).alias("bin")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    dealt = bins.repartition("end_conv_id", "depth").sortWithinPartitions("end_conv_id", "depth", "bin").select("end_conv_id", "depth", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest, out = None, None, []

        def rows(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in done], pa.int64()), pa.array([r[1] for r in done], pa.int64()), pa.array([r[2] for r in done], pa.string())], ["end_conv_id", "depth", "ends_sha256"])

        for b in batches:
            for conv, depth, ids in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if (conv, depth) == node:
                    digest.update(b"," + ids.encode())
                    continue
                if node:
                    out.append((*node, digest.hexdigest()))
                node, digest = (conv, depth), hashlib.sha256(ids.encode())
            if len(out) > 10_000:
                yield rows(out)
                out = []
        if node:
            out.append((*node, digest.hexdigest()))
        yield rows(out)

    return dealt.select(F.col("end_conv_id").cast("bigint"), "depth", "ids").mapInArrow(run, "end_conv_id bigint, depth bigint, ends_sha256 string")

"""Prefix tries against a dictionary of prefixes."""

import hashlib
import random

from pyspark.sql import functions as F

from assayline.llm import trie


def brute(convs):
    """{(least member, depth): (parent's least, members, children, leaves, saved, digest)} of {conv_id: [(role, text)]}."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def below(p):
        leaves, saved = 0 if p in kids else 1, (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        for k in kids.get(p, []):
            a, b = below(k)
            leaves, saved = leaves + a, saved + b
        return leaves, saved

    out = {}
    for p, who in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in who if len(convs[c]) == len(p)))
        out[min(who), len(p)] = (min(members[p[:-1]]) if p else None, len(who), len(kids.get(p, [])), *below(p), hashlib.sha256(ends.encode()).hexdigest())
    return out


def built(spark, rows, convs=None):
    schema = "conv_id bigint, turn int, role string, text string, label string, depth int"
    turns = trie.ordered_turns(spark.createDataFrame([(*r, "x", 1) for r in rows], schema))
    counts = turns.groupBy("conv_id").agg(F.max("n").alias("n")) if convs is None else spark.createDataFrame(convs, "conv_id bigint, n bigint")
    nodes, ends = trie.prefix_trie(turns.select("conv_id", "pos", "h", "chars"), counts)
    digests = {(r.end_conv_id, r.depth): r.ends_sha256 for r in trie.end_digests(ends).collect()}
    return {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, digests.get((r.conv_id, r.depth), trie.EMPTY_SHA256)) for r in nodes.collect()}


def test_trie_equals_brute_force(spark):
    rng = random.Random(4)
    convs = {}
    for c in range(0, 200):
        convs[c] = [(rng.choice("ua"), "xyz"[rng.randrange(rng.choice([1, 2, 3]))] * rng.randrange(3)) for _ in range(rng.choice([1, 2, 3, 6, 11]))]
    for c in range(300, 330):  # copies, one of them going on; beginnings of others
        convs[c] = [("u", f"long {i}") for i in range(9)]
    convs[329] += [("a", "ü€😀")] * 20
    convs[2**40] = [("u", f"long {i}") for i in range(5)]
    rows = [(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    convs[7_000] = []
    counts = [(c, len(t)) for c, t in convs.items()]
    got = built(spark, rows, counts)
    assert got == brute(convs)


def test_awkward_turns(spark):
    rows = [(1, None, None, None), (1, 3, "u", "b"), (1, 2, "u", "a"), (2, 1, "", ""), (2, 2, "u", "a"), (None, 1, "u", "lost"), (None, 2, "u", "lost"), (3, 1, "u", "w " * 50_000)]
    want = brute({1: [("", ""), ("u", "a"), ("u", "b")], 2: [("", ""), ("u", "a")], 3: [("u", "w " * 50_000)]})
    assert built(spark, rows) == want
    # repeated rows are turns of their own, equal numbers come in a fixed order
    again = built(spark, [(1, 1, "u", "a"), (1, 1, "u", "a"), (1, 1, "u", "b"), (2, 1, "u", "b"), (2, 1, "u", "a"), (2, 1, "u", "a")])
    assert again[1, 0][1:4] == (2, 1, 1) and len(again) == 4
    assert built(spark, [], []) == {}


def test_digests_stream_over_ranges(spark):
    ids = [*range(0, 30_000, 7), 10**12]
    ends = spark.createDataFrame([(i,) for i in ids], "conv_id bigint").select("conv_id", F.lit(0).cast("bigint").alias("end_conv_id"), F.lit(2).cast("bigint").alias("depth"))
    (row,) = trie.end_digests(ends).collect()
    assert row.ends_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()

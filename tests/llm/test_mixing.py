"""Mixing sources: quotas against a heap of quotients, targets, and what documents give."""

import heapq
import random

from assayline.llm import mixing


def by_heap(votes, seats):
    """The seats of each unit, one after another to the highest quotient, the smaller unit among equals."""
    got = dict.fromkeys(votes, 0)
    heap = [(-v, u) for u, v in votes.items() if v > 0]
    heapq.heapify(heap)
    for _ in range(seats if heap else 0):
        _, u = heapq.heappop(heap)
        got[u] += 1
        heapq.heappush(heap, (-votes[u] / (2 * got[u] + 1), u))
    return got


def test_apportion_equals_a_heap(spark):
    rng = random.Random(5)
    cases = {"tiny": ({i: 1 for i in range(40)}, 7), "giant": ({0: 10**9, 1: 1, 2: 3, 3: 0}, 1000), "none": ({0: 5, 1: 2}, 0), "empty": ({0: 0}, 9), "ties": ({i: 6 for i in range(9)}, 31)}
    for i in range(12):
        cases[f"r{i}"] = ({u: rng.choice([0, 1, 5, rng.randrange(10_000), rng.randrange(10)]) for u in range(rng.randrange(1, 60))}, rng.randrange(300))
    rows = [(k, u, v, s) for k, (votes, s) in cases.items() for u, v in votes.items()]
    got = mixing.apportion(spark.createDataFrame(rows, "k string, u int, votes bigint, seats bigint"), ["k"], "u", "q").collect()
    assert {(r.k, r.u): r.q for r in got} == {(k, u): q for k, (votes, s) in cases.items() for u, q in by_heap(votes, s).items()}


def test_shares_are_capped_and_reshared(spark):
    sources = spark.createDataFrame([(1, 10, 3), (2, 1000, 1), (3, 100, 2), (4, 0, 1)], "sid int, size bigint, weight int")
    got = {r.sid: r.target for r in mixing.capped_shares(sources, 1500.0, 2).collect()}
    assert got == {1: 20.0, 2: 1280.0, 3: 200.0, 4: 0.0}
    assert {r.target for r in mixing.capped_shares(sources, 99_999.0, 2).collect()} == {20.0, 2000.0, 200.0, 0.0}


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.choice([0, 1, 40, 300, 700]), rng.choice(["b", "b", "b", "a", "ü", "c d", None]), "x", 1) for i in range(900)]
    rows += [(5000, "same text " * 3, "b", "x", 1)] * 5000 + [(None, None, None, "x", 1), (None, "", "a", "x", 1), (6000, "long " * 50_000, "c d", "x", 1)] + [(7000, "other", "a", "x", 1), (7000, "text of the same id", "a", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string, size string, shard int")
    got = mixing.mix(docs, rows_per_shard=64).collect()
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((i or -1, len((t or "").split())) for i, t, *_ in rows)
    again = mixing.mix(docs.repartition(3), rows_per_shard=64).collect()
    key = sorted(repr((r.doc_id, r.source, r.size, r.target, r.taken)) for r in got)
    assert key == sorted(repr((r.doc_id, r.source, r.size, r.target, r.taken)) for r in again)
    sizes, taken, targets = {}, {}, {}
    for r in got:
        assert r.taken == sum(s.length for s in r.spans) <= 2 * r.size and all(0 <= s.start and s.start + s.length <= r.size and s.length > 0 for s in r.spans)
        sizes[r.source], taken[r.source], targets[r.source] = sizes.get(r.source, 0) + r.size, taken.get(r.source, 0) + r.taken, r.target
        assert r.source_size == sum(len((t or "").split()) for _, t, s, *_ in rows if s == r.source)
    assert abs(sum(targets.values()) - 1.5 * sum(sizes.values())) < 1e-6
    assert all(abs(taken[s] - targets[s]) <= max(48, 0.005 * targets[s]) for s in sizes)


def test_mixed_texts_and_empty(spark):
    docs = spark.createDataFrame([(i, " ".join(f"d{i}w{k}" for k in range(50)), "ab"[i % 2]) for i in range(20)], "doc_id int, text string, source string")
    mixed = mixing.mix(docs)
    texts = mixing.mixed_texts(docs, mixed).collect()
    assert sum(len(r.text.split()) for r in texts) == sum(r.taken for r in mixed.collect())
    assert all(w.startswith(f"d{r.doc_id}w") for r in texts for w in r.text.split())
    assert mixing.mix(docs.limit(0)).count() == 0

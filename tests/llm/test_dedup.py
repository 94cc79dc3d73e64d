"""Substring, SimHash and embedding deduplication against brute force."""

import hashlib
import itertools
import random

import numpy as np
import pytest
import xxhash

from assayline.llm import simhash, substring, vectors
from assayline.llm.components import connected_components

DOCS = "doc_id bigint, text string, component_id string, places int"


def docs_frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)


# --- substring -----------------------------------------------------------------------------------
def removed_by_brute_force(rows, window):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    starts = {}
    for i, w in split:
        for k in range(len(w) - window + 1):
            starts.setdefault(tuple(w[k : k + window]), set()).add(i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and any(j is not None and j < i for j in starts[tuple(w[k : k + window])]):
                gone |= set(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed=0):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "ab", "ü", "c.", "dd"])
    passage = [[word() for _ in range(n)] for n in (12, 20, 31, 9)]
    rows = []
    for i in range(40):
        w = [word() + str(rng.randrange(50)) for _ in range(rng.randrange(0, 60))]
        for p in rng.sample(passage, rng.randrange(0, 3)):
            at = rng.randrange(len(w) + 1)
            p = list(p)
            if rng.random() < 0.3:
                p[rng.randrange(len(p))] = "zz"
            w[at:at] = p
        rows.append((i, "\t".join(w[:5]) + " \n" + " ".join(w[5:])))
    rows += [(40, None), (41, ""), (42, rows[3][1]), (42, rows[3][1]), (43, "x y " * 40), (44, "x y " * 60), (45, " ".join(["q"] * 30)), (None, rows[5][1]), (3, rows[7][1])]
    return rows


@pytest.mark.parametrize("window,seed", [(10, 4), (16, 8)])
def test_substring(spark, window, seed):
    rows = corpus(window)
    got = substring.remove_repeats(docs_frame(spark, rows), window, seed, carry=["component_id", "places"]).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got], key=repr) == removed_by_brute_force(rows, window)
    assert all(r.component_id == "x" and r.places == 1 for r in got)
    whole = {(i, t) for i, t in rows}
    assert all((r.doc_id, r.text) in whole for r in got if not r.n_removed)


def test_substring_refuses_clashing_names(spark):
    with pytest.raises(ValueError):
        substring.remove_repeats(spark.createDataFrame([(1, "a", 2)], "doc_id bigint, text string, spans int"), carry=["spans"])


def test_substring_empty_and_long(spark):
    assert substring.remove_repeats(docs_frame(spark, [])).count() == 0
    long = " ".join(f"w{i}" for i in range(250_000))
    got = {r.doc_id: r for r in substring.remove_repeats(docs_frame(spark, [(2, long), (1, long[: len(long) // 2])])).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == got[1].n_words - 1 and len(got[2].spans) == 1


# --- simhash -------------------------------------------------------------------------------------
def fingerprint_by_brute_force(text):
    w = ((text or "").encode().lower()).split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_brute_force(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in itertools.combinations(nodes, 2):
        if linked(a, b):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprint():
    for t in (None, "", " \n", "One", "A b C", "a b c d", "a b c d e É é", "x " * 500):
        assert simhash.fingerprint(None if t is None else t.encode()) == fingerprint_by_brute_force(t)


def test_simhash_components(spark):
    rng = random.Random(5)
    base = [[rng.choice("abcdefgh") + str(rng.randrange(99)) for _ in range(120)] for _ in range(6)]
    rows = []
    for i in range(70):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(len(w))] = "edit" + str(i)
        rows.append((i, " ".join(w)))
    rows += [(70, None), (71, ""), (72, rows[0][1]), (72, rows[0][1]), (None, rows[1][1])]
    got = simhash.near_duplicates(docs_frame(spark, rows)).collect()
    fps = {f: f for f in {fingerprint_by_brute_force(t) for _, t in rows}}
    comp = components_by_brute_force(sorted(fps), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for i, t in rows:
        if i is not None:
            c = comp[fingerprint_by_brute_force(t)]
            least[c] = min(i, least.get(c, i))
    want = sorted([(i, fingerprint_by_brute_force(t), least[comp[fingerprint_by_brute_force(t)]]) for i, t in rows], key=repr)
    assert sorted([(r.doc_id, r.fp % 2**64, r.component_id) for r in got], key=repr) == want
    kept = simhash.keep_one(docs_frame(spark, rows))
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(set(least.values()))
    assert kept.columns == ["doc_id", "text", "component_id", "places"]


@pytest.mark.parametrize("tile", [8192, 8])
def test_simhash_links_lose_nothing(spark, tile):
    rng = random.Random(1)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 7))) for _ in range(150)} | {rng.getrandbits(64) for _ in range(100)}
    fps = sorted(fps)
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp bigint")
    edges = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(df, tile=tile).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in edges)
    own = {tuple(sorted(e)) for e in edges}
    assert components_by_brute_force(fps, lambda a, b: (a, b) in own) == components_by_brute_force(fps, lambda a, b: (a ^ b).bit_count() <= 4)


def test_simhash_keeps_a_row_of_each_group_where_ids_repeat(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(0, b), (1, a), (1, b), (1, a), (2, c), (3, c + " end"), (None, a)]
    kept = sorted(((r.doc_id, r.text) for r in simhash.keep_one(spark.createDataFrame([(*r, 1, "f") for r in rows], "doc_id bigint, text string, th int, fp string")).collect()), key=repr)
    assert kept == sorted([(0, b), (1, a), (2, c), (None, a)], key=repr)


def test_simhash_empty(spark):
    assert simhash.near_duplicates(docs_frame(spark, [])).count() == 0
    assert simhash.keep_one(docs_frame(spark, [])).count() == 0


# --- components ----------------------------------------------------------------------------------
def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(45)] + [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 230)] + [(5, 5), (None, 1)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    real = {tuple(sorted(e)) for e in edges if None not in e and e[0] != e[1]}
    nodes = sorted({n for e in real for n in e})
    assert got == components_by_brute_force(nodes, lambda a, b: (a, b) in real)
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


# --- embeddings ----------------------------------------------------------------------------------
def test_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 16))
    x = [(base[i % 12] + rng.normal(size=16) * (0.02 if i % 3 else 0.4)).tolist() for i in range(150)]
    rows = [(i, v, "c") for i, v in enumerate(x)] + [(150, x[0], "c"), (151, x[0], "c"), (152, None, "c"), (153, [0.0] * 16, "c"), (154, [float("nan")] * 16, "c"), (155, [None] * 16, "c"), (156, [1.0, 2.0], "c"), (157, [2.0, 4.0], "c"), (None, x[0], "c")]
    got = {r.vec_id: r for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, component string"), tile=16).collect()}
    ok = {i: np.array(v) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    cos = lambda a, b: len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= 0.95
    comp = components_by_brute_force(sorted(ok), cos)
    links = {i: sum(cos(i, j) for j in ok if j != i) for i in ok}
    assert {i: (got[i].n_links, got[i].component_id, got[i].kept) for i in ok} == {i: (links[i], comp[i], comp[i] == i) for i in ok}
    for i in (152, 153, 154, 155):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, False)
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_vectors_in_a_hot_cone(spark):
    """Isolated pairs at cosine 0.951 among vectors that all have cosine 0.8 with each other."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12_000, 64)) + 0.0
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    axis = np.eye(64)[0]
    x = np.sqrt(0.8) * axis + np.sqrt(0.2) * (x - np.outer(x[:, 0], axis)) / np.linalg.norm(x[:, 1:], axis=1)[:, None]
    e = rng.normal(size=(300, 64))
    e -= np.einsum("ij,ij->i", e, x[:300])[:, None] * x[:300]
    x[300:600] = 0.951 * x[:300] + np.sqrt(1 - 0.951**2) * e / np.linalg.norm(e, axis=1, keepdims=True)
    cos = x @ x.T
    np.fill_diagonal(cos, 0)
    want = (cos >= 0.95).sum(1)
    assert (want[:600] > 0).all()
    got = {r.vec_id: r for r in vectors.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")).collect()}
    assert [got[i].n_links for i in range(len(x))] == want.tolist()
    assert all(got[i].component_id == got[i + 300].component_id for i in range(300))


def test_vectors_over_many_ranges(spark):
    """A third of the vectors hang together, 100 sparse pairs stand at 0.96, and ranges are short enough that some are cut finer."""
    rng = np.random.default_rng(5)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x = unit(rng.normal(size=(6000, 32)))
    x[:2000] = unit(x[0] + 0.02 * rng.normal(size=(2000, 32)))
    e = rng.normal(size=(100, 32))
    e -= np.einsum("ij,ij->i", e, x[3000:3100])[:, None] * x[3000:3100]
    x[4000:4100] = 0.96 * x[3000:3100] + np.sqrt(1 - 0.96**2) * unit(e)
    x = x.astype(np.float32)
    d = unit(x.astype(np.float64))
    cos = d @ d.T
    np.fill_diagonal(cos, 0)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = {r.vec_id: r for r in vectors.near_duplicates(rows, tile=64, window=128, sample=2000).collect()}
    assert [got[i].n_links for i in range(6000)] == (cos >= 0.95).sum(1).tolist()
    assert all(got[i].component_id == 0 for i in range(2000)) and all(got[i + 1000].component_id == i for i in range(3000, 3100))


def test_vectors_just_below_the_threshold(spark):
    """A pair that is no link shares no component."""
    c = 0.95 - 5e-10
    rows = [(1, [1.0, 0.0]), (2, [c, float(np.sqrt(1 - c * c))])]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got} == {(1, 0, 1, True), (2, 0, 2, True)}

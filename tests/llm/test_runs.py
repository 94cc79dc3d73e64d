"""Periodic runs against a brute force over all periods."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from assayline.llm.runs import _collapsed, find_runs, periodic_runs


def brute(words, power=4, least=6):
    """Every longest stretch whose words repeat q places on, by its smallest q."""
    n, out = len(words), {}
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, power * q) and j > i:
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in out.items())


def runs_of(texts, power=4, least=6):
    runs, first = find_runs(texts, power, least)
    return [[(int(s - at), int(n), int(q)) for s, n, q in runs if at <= s < at + len(t)] for at, t in zip(first, texts, strict=True)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=14), st.integers(1, 9)), max_size=4), st.sampled_from([(4, 6), (3, 2), (2, 2)]))
def test_runs_equal_brute_force(made, kind):
    texts = [t * k for t, k in made]
    assert runs_of(texts, *kind) == [brute(t, *kind) for t in texts]


def test_long_text_with_nested_periods():
    rng = random.Random(3)
    inner = [b"%d" % rng.randrange(50) for _ in range(300)] + [b"x", b"y"] * 9
    text = [b"%d" % i for i in range(500)] + inner * 6 + [b"z"] * 40
    (got,) = runs_of([text])
    assert got == brute(text)
    assert (500, len(inner) * 6, len(inner)) in got and (len(text) - 40, 40, 1) in got


def test_awkward_rows(spark):
    long = "w " * 30_000 + "end"
    rows = [Row(doc_id=1, text=None, runs="x", n_words=7), Row(doc_id=2, text="", runs="x", n_words=7), Row(doc_id=3, text=" \t\r\n\x0b\x0c", runs="x", n_words=7), Row(doc_id=4, text="a a a a a", runs="x", n_words=7), Row(doc_id=5, text="a a a a a a a a", runs="x", n_words=7)]
    rows += [Row(doc_id=None, text="b c " * 4 + "b", runs="x", n_words=7)] * 2 + [Row(doc_id=6, text=long, runs="x", n_words=7)]
    got = periodic_runs(spark.createDataFrame(rows, "doc_id int, text string, runs string, n_words int"))
    out = sorted(((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], bytes(r.collapsed).decode()) for r in got.collect()), key=lambda r: (r[0], r[1]))
    assert out == [(0, 9, [(0, 9, 2)], "b c"), (0, 9, [(0, 9, 2)], "b c"), (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 5, [], "a a a a a"), (5, 7, [(1, 6, 1)], "a a a"), (6, 30_001, [(0, 30_000, 1)], "w end")]
    assert periodic_runs(spark.createDataFrame([], "doc_id string, text string")).count() == 0


def test_query_on_texts_without_words(spark, tmp_path):
    """Texts without words whose ids are among those that get a periodic ending stay empty."""
    import hashlib
    import zlib

    from assayline.llm.queries import op13_periodic_runs

    mine = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:4]
    texts = dict(zip(mine, ("", " \t\n", None, "a b"), strict=True))
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op13_periodic_runs(spark, str(tmp_path)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert set(got) == set(mine) and all(r.n_runs == 0 and r.start is None for r in got.values())
    assert [got[i].collapsed_sha256 == empty for i in mine] == [True, True, True, False] and all(r.runs_sha256 == empty for r in got.values())


@pytest.mark.parametrize("text,kept", [(b"a b a b a b a b c", b"a b c"), (b"c c c c c c d d d d d d", b"c d"), (b"one two", b"one two")])
def test_collapse(text, kept):
    import numpy as np

    words = text.split()
    assert _collapsed(words, np.array(brute(words), np.int64).reshape(-1, 3)) == kept

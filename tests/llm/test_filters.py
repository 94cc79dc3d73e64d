"""Decontamination, licences, urls and revisits against brute force and SQL."""

import hashlib
import random
import re
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from assayline.llm import decontam, licenses, queries, urls, warc


# --- decontamination -----------------------------------------------------------------------------
def words(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def contaminated_by_brute_force(docs, items, size):
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, u in items:
            v = words(u)
            n = min(size, len(v))
            for k in range(len(v) - n + 1 if n and i is not None else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[k : k + n]:
                        hit |= set(range(p, p + n))
                        found.add(str(i))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def test_decontamination(spark):
    rng = random.Random(0)
    vocabulary = ["a", "b", "É", "c1", "dd", "e"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 3, 5, 9, 14])))) for i in range(15)] + [(15, None), (None, "a b a"), (3, "A, B! a")]
    docs = [(i, rng.choice([" ", "-", "\n"]).join(rng.choice(vocabulary) + rng.choice(["", "", "7"]) for _ in range(rng.randrange(0, 40)))) for i in range(30)]
    docs += [(30, None), (31, ""), (1, "A b É c1"), (1, "A b É c1"), (None, "a b a b"), (33, "--- ..."), (34, "x " * 5000 + " ".join(["a", "b", "É"]))]
    d = spark.createDataFrame([(i, t, 5, "z") for i, t in docs], "doc_id bigint, text string, n_words int, th string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    for limit in (200_000, 0):
        got = decontam.contamination(d, b, window=5, broadcast_rows=limit)
        assert sorted(map(tuple, got.collect()), key=repr) == contaminated_by_brute_force(docs, items, 5)
    assert [r.contaminated for r in decontam.contamination(d, b.limit(0)).collect()] == [False] * len(docs)
    assert decontam.contamination(d.limit(0), b).count() == 0


def test_decontamination_of_a_long_text_by_shuffles(spark):
    rng = random.Random(4)
    item = [f"q{i}" for i in range(40)]
    w = [f"w{rng.randrange(5000)}" for _ in range(200_000)]
    w[150_000:150_030] = item[5:35]
    docs = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(w[:500]))], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(w[300:320]) + " other")], "item_id bigint, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontam.contamination(docs, items, broadcast_rows=0).collect()}
    assert got == {1: (200_000, 50, 2), 2: (500, 20, 1)}


# --- licences ------------------------------------------------------------------------------------
def test_licences(spark):
    mit = dict(licenses.TEMPLATES)["MIT-permission"]
    filler = " ".join(f"word{i}" for i in range(200))
    rows = [(1, f"{filler} {mit} {filler}"), (2, f"{filler} Released under the MIT License. {filler}"), (3, mit.replace("publish", "print")), (4, None), (5, ""), (6, filler), (7, "released under the"), (2, f"{filler} Released under the MIT License. {filler}"), (None, "licensed UNDER cc by-nc 4.0")]
    got = {(r.doc_id, r.license): r.containment for r in licenses.scan(spark.createDataFrame([(i, t, "h") for i, t in rows], "doc_id bigint, text string, license string")).collect()}
    assert got[1, "MIT-permission"] == 1 and got[2, "MIT-line"] == 1 and 0.8 <= got[3, "MIT-permission"] < 1 and got[None, "CC-BY-NC-4.0-line"] == 1
    assert {k[0] for k in got} == {1, 2, 3, None}
    assert licenses.scan(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


# --- urls ----------------------------------------------------------------------------------------
def test_urls(spark):
    rows = [
        (1, "http://A.b.net/x?q#f", None), (2, "https://www.example.net/en/1", ""), (3, "http://example.com/de/a", "<p>"), (4, "http://example.com/fr/a", "x"), (5, "https://sub.org/fr/2", "x"), (6, None, "x"), (7, "no scheme", None), (8, "http://net", "x"), (8, "http://net", "x"),
        (9, "http://clean.example.com/a", '<LINK href="http://clean.example.com/b" REL="canonical">'), (10, "http://clean.example.com/b#top", '<meta http-equiv="refresh" content="0; url=//bad.net/">'),
        (11, "http://allowed.org/fr/", "<link rel=canonical href='http://clean.example.com/a'>"), (12, "http://other.org/x", '<a rel="canonical" href="http://bad.net/">'), (13, "http://via.org/start", "x"),
    ]
    pages = spark.createDataFrame([(*r, "n") for r in rows], "page_id bigint, url string, html string, node string")
    redirects = spark.createDataFrame([("http://via.org/start", "http://clean.example.com/a"), (None, "http://x.org")], "from_url string, to_url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, queries.RULES, redirects).collect()}
    assert got[1] == ("a.b.net", "/x", "net/", "block") and got[2] == ("www.example.net", "/en/1", "example.net/en/", "allow")
    assert got[3][2:] == ("example.com/de/", "block") and got[4][2:] == (None, "allow") and got[5][2:] == ("org/fr/", "allow")
    assert got[6] == ("", "", None, "allow") == got[7] and got[8] == ("net", "", None, "allow")
    assert got[9][2:] == (None, "block") and got[10][2:] == (None, "block") and got[11][2:] == ("org/fr/", "allow") and got[12][3] == "allow" and got[13][3] == "block"
    assert urls.judge(pages, queries.RULES).count() == len(rows) and urls.judge(pages.limit(0), queries.RULES).count() == 0
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", [list(r) for r in rows])
    want = sorted(((r[0], *r[1:]) for r in con.sql(f"SELECT page_id, host, path, rule, verdict FROM ({queries.ORACLE_SQL['op8_url_filter']})").fetchall()), key=repr)
    assert sorted([(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, queries.RULES).collect()], key=repr) == want


# --- revisits ------------------------------------------------------------------------------------
def at(day, hour=0):
    return datetime(2024, 1, day, hour)


def test_revisits(spark):
    r = [
        (1, "http://www.a.com/x/", at(1), "response", {"etag": '"1"', "last-modified": "m1", "content-type": "text/html"}), (2, "https://a.com/x?utm_source=f#t", at(1, 5), "revisit", {"etag": 'W/"1"', "date": "d2", "content-type": "none"}),
        (3, "http://a.com/x", at(3), "response", {"etag": '"3"'}), (4, "http://a.com/x", at(9), "revisit", {"etag": '"1"'}), (5, "http://a.com/x", at(3), "revisit", {"last-modified": "m1"}),
        (6, "http://b.com", at(1), "revisit", {}), (7, None, at(1), "revisit", {}), (8, "http://a.com/x", None, "revisit", {}), (9, "http://a.com/x", at(20), "revisit", None), (10, "http://a.com/x", at(3), "response", {"etag": '"10"'}), (10, "http://a.com/x", at(3), "response", {"etag": '"10"'}),
        (11, "http://a.com/x", at(4), "other", {}),
    ]
    df = spark.createDataFrame([(*x, "c") for x in r], "record_id bigint, url string, captured_at timestamp, kind string, headers map<string,string>, bucket string")
    for seconds in (3600, 86_400, 10**9):
        got = {x.record_id: (x.ref_id, x.outcome, x.headers) for x in warc.resolve_revisits(df, seconds).collect()}
        assert got[1][:2] == (1, "full") and got[2] == (1, "resolved", {"etag": 'W/"1"', "last-modified": "m1", "content-type": "text/html", "date": "d2"})
        assert got[4][:2] == (10, "mismatch") and got[5][:2] == (1, "resolved") and got[9][:2] == (10, "unchecked")
        assert all(got[i][:2] == (None, "missing") for i in (6, 7, 8, 11))
    assert warc.resolve_revisits(df).count() == len(r) and warc.resolve_revisits(df.limit(0)).count() == 0


@pytest.mark.parametrize("url,key", [("HTTP://WWW.Ex.com:80", "ex.com/"), ("http://ex.com/a/?b=2&a=1&utm_x=3", "ex.com/a?a=1&b=2"), ("//u:p@ex.com/A", "ex.com/A"), ("", "/")])
def test_canonical(spark, url, key):
    if url.startswith("//"):
        url = "http:" + url
    assert spark.createDataFrame([(url,)], "u string").select(warc.canonical_url(F.col("u"))).first()[0] == key


def test_revisits_without_urls_and_with_long_texts(spark):
    """Rows without a url or time never meet in a join; their results are as ever. Very long urls and headers pass through."""
    long = "http://a.com/" + "p" * 100_000
    rows = [(i, None if i % 3 else long, None if i % 2 else at(1), "response" if i % 5 else "revisit", {"etag": "e" * 50_000} if i == 30 else {"etag": '"1"'}) for i in range(1, 400)] + [(1000, long, at(2), "revisit", {"etag": '"1"'})]
    df = spark.createDataFrame(rows, "record_id bigint, url string, captured_at timestamp, kind string, headers map<string,string>")
    found = warc.resolve_revisits(df)
    got = {r.record_id: (r.ref_id, r.outcome) for r in found.collect()}
    assert len(got) == len(rows) and got[1000] == (396, "resolved")
    for i, url, when, kind, _ in rows[:-1]:
        if kind == "response":
            assert got[i] == (i, "full")
        elif url is None or when is None:
            assert got[i] == (None, "missing")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Union" in plan


def test_urls_without_links_and_with_long_texts(spark):
    long = "http://net/" + "x" * 200_000
    rows = [(i, None, "x") for i in range(500)] + [(1000, long, "y" * 500_000), (1001, "http://far.org/", f'<link rel="canonical" href="{long}">')]
    got = {r.page_id: (r.host, r.rule, r.verdict, r.component) for r in urls.judge(spark.createDataFrame(rows, "page_id bigint, url string, html string"), queries.RULES).collect()}
    assert len(got) == len(rows) and all(got[i] == ("", None, "allow", None) for i in range(500))
    assert got[1000][:3] == ("net", "net/", "block") and got[1001][:3] == ("far.org", None, "block")


def test_licences_in_a_long_text(spark):
    name, text = licenses.TEMPLATES[0]
    rows = [(1, "filler words " * 30_000 + text + " more" * 20_000), (2, "filler words " * 30_000)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(r.doc_id, r.license) for r in got} == {(1, name)} and got[0].containment == 1.0


def test_word_class_is_the_contracts(spark):
    """Words said by what is in them are those of the contract's class, for every kind of character; the positive class is what saves the time."""
    from pyspark.sql import functions as F

    from assayline.llm import decontam

    marks = [chr(c) for c in (*range(0x300), 0x7FF, 0x800, 0xD7FF, 0xE000, 0xFFFF, 0x10000, 0x1F600, 0x10FFFF)]
    df = spark.createDataFrame([(f"a{m}B {m}{m}1",) for m in marks] + [("",), (None,)], "text string")
    told = F.regexp_extract_all(decontam.ascii_lower(F.coalesce("text", F.lit(""))), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    rows = df.select(decontam.word_array(F.col("text")).alias("w"), told.alias("want"), decontam.word_count(F.col("text")).alias("n")).collect()
    assert len(rows) == len(marks) + 2 and all(r.w == r.want and r.n == len(r.want) for r in rows)
    assert not decontam.WORD.startswith("[^")

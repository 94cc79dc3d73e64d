"""Classifiers: held-out accuracy, exact neighbours, edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayline.llm import quality, toxicity
from assayline.llm.common import fold_of, table

SF = "/root/testdata/sf0.01"


def held(scored, labels, label, folds, fold):
    rows = scored.join(labels, "doc_id").where(fold_of(F.col("doc_id"), folds) == fold).select("score", "predicted", label).collect()
    return np.array([[r.score, r.predicted, r[label]] for r in rows])


def test_quality_held_out(spark):
    labels = table(spark, SF, "labels")
    out = quality.scores(table(spark, SF, "documents").select("doc_id", "text"), labels.select("doc_id", F.col("quality").alias("label")), fold_of(F.col("doc_id"), 5) != 0)
    got = held(out, labels, "quality", 5, 0)
    assert out.count() == 1000 and ((got[:, 0] >= 0) & (got[:, 0] <= 1)).all() and (got[:, 1] == got[:, 2]).mean() > 0.95


def test_toxicity_held_out(spark):
    labels = table(spark, SF, "labels")
    out = toxicity.scores(table(spark, SF, "documents").select("doc_id", "text"), labels.select("doc_id", "toxic"), fold_of(F.col("doc_id"), 4) != 2)
    got = held(out, labels, "toxic", 4, 2)
    clean = got[got[:, 2] == 0]
    assert out.count() == 1000 and (got[:, 1] == got[:, 2]).mean() > 0.9 and clean[:, 1].mean() < 0.05


def test_discriminant_is_the_density_ratio():
    rng = np.random.default_rng(0)
    x = [rng.normal(0, 1, (400, 3)), rng.normal(1, 2, (300, 3))]
    m = quality.Discriminant.fit(np.array([400.0, 300.0]), np.array([a.sum(0) for a in x]), np.array([a.T @ a for a in x]), 0.0, 0.0)
    p = rng.normal(size=(5, 3))
    dens = []
    for a, n in zip(x, (400, 300)):
        c, d = np.cov(a.T, ddof=0), p - a.mean(0)
        dens.append(np.log((n + 0.5) / 701) - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) - 0.5 * np.linalg.slogdet(c)[1])
    np.testing.assert_allclose(m.score(p), 1 / (1 + np.exp(dens[0] - dens[1])), rtol=1e-6)


def test_nearest_is_exact():
    rng = np.random.default_rng(1)
    ix = toxicity.Index(rng.uniform(1, 3, 40), 40, list(range(500)), rng.integers(0, 2, 500), np.ones(500), k=7)
    vs = []
    for _ in range(500):
        t = np.sort(rng.choice(40, rng.integers(1, 6), replace=False))
        vs.append((t, ix.unit(t, rng.integers(1, 4, len(t)))))
    ix.add(vs)
    dense = np.zeros((500, 40))
    for i, (t, v) in enumerate(vs):
        dense[i, t] = v
    for q in range(0, 500, 25):
        cos = np.round(dense @ dense[q], 12)
        cos[q] = 0
        want = sorted(((c, -i) for i, c in enumerate(cos) if c > 0), reverse=True)[:7]
        got = ix.nearest(*vs[q], skip=q)
        assert [(pytest.approx(c), -i) for c, i in want] == got


EDGE = [(1, None), (2, ""), (3, "word " * 30_000), (4, "\n\t"), (4, "\n\t"), (None, "idiot"), (6, "idiot scum"), (7, "fine day")]


@pytest.mark.parametrize("labelled", [[], [(6, 1)], [(6, 1), (7, 0), (7, 0), (None, 1), (2, None)]])
def test_edges(spark, labelled):
    docs = spark.createDataFrame([(i, t, 1.0, "c") for i, t in EDGE], "doc_id bigint, text string, score double, predicted string")
    labels = spark.createDataFrame(labelled, "doc_id bigint, toxic int")
    for out in (toxicity.scores(docs, labels, F.lit(True)), quality.scores(docs, labels.withColumnRenamed("toxic", "label"), F.lit(True))):
        rows = out.collect()
        assert len(rows) == len(EDGE) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert toxicity.scores(docs.limit(0), labels, F.lit(True)).count() == 0
    assert quality.scores(docs.limit(0), labels.withColumnRenamed("toxic", "label"), F.lit(True)).count() == 0


def test_evidence(spark):
    docs = spark.createDataFrame([(i, "loweiA vile" if i % 4 == 0 else f"plain text {i}") for i in range(200)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(150)], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.scores(docs, labels, F.lit(True)).collect()}
    assert got[160].predicted == 1 and got[161].predicted == 0
    assert got[160].evidence[0].toxic == 1 and got[160].evidence[0].cosine == pytest.approx(1)
    assert all(e.example != 4 for e in got[4].evidence)


def test_copies_are_one_example(spark):
    """80 copies of one labelled text weigh its words no more than one does."""
    rng = np.random.default_rng(8)
    bag = [f"{a}{b}" for a in "kmtp" for b in ("alu", "eni", "oro", "ist")]
    texts = [" ".join(rng.choice(bag, 20)) + (" vile" if i % 3 == 0 else "") for i in range(120)]
    one = spark.createDataFrame([*enumerate(texts), (500, "neutral words of a copied page")], "doc_id bigint, text string")
    many = one.unionByName(spark.range(501, 580).selectExpr("id as doc_id", "'neutral words of a copied page' as text"))
    got = []
    for docs in (one, many):
        labels = docs.where("doc_id < 120 or doc_id >= 500").selectExpr("doc_id", "cast(doc_id % 3 = 0 or doc_id >= 500 as int) as toxic")
        examples = toxicity.example_texts(docs.select("doc_id", F.col("text").cast("binary").alias("text")), toxicity.sample_examples(labels, F.lit(True), 4096))
        got.append(toxicity.weigh_terms(examples.select("text", "toxic"), 4.0, 8.0, 0.05))
        assert examples.count() == 121
    assert got[0][0] == got[1][0] and got[0][1].tolist() == got[1][1].tolist()


def test_neighbours_votes_and_scores_over_whole_texts(spark):
    """Words that go with no class, are seen once, or that no example has count: neighbours, votes and scores are those of a brute-force cosine over all terms."""
    rng = np.random.default_rng(5)
    bag = [f"{a}{b}{c}" for a in "kmt" for b in "aeiou" for c in "lnrs"]
    texts = [" ".join(rng.choice(bag, 30)) + (" vile" if i % 5 == 0 else "") + (f" rareone{i // 2}" if i < 60 else "") + (f" unseen{i} strange strange word{i % 3}" if i >= 120 else "") for i in range(160)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    toxic = {i: int(i % 5 == 0) for i in range(120)}
    labels = spark.createDataFrame(list(toxic.items()), "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.scores(docs, labels, F.lit(True)).collect()}
    bags = [[t for w in toxicity.words(x.encode()) for t in toxicity.terms(w)] for x in texts]
    at = {t: j for j, t in enumerate(sorted({t for b in bags for t in b}))}
    tf = np.zeros((160, len(at)))
    for i, b in enumerate(bags):
        for t in b:
            tf[i, at[t]] += 1
    y, on = np.array([toxic[i] for i in range(120)]), tf[:120] > 0
    a, b = on[y == 1].sum(0) + 0.5, on[y == 0].sum(0) + 0.5
    c, d = (y == 1).sum() + 1 - a, (y == 0).sum() + 1 - b
    odds = np.abs(np.log(a * d / (b * c)))
    weight = 0.05 + 0.95 * np.minimum(odds / np.sqrt(1 / a + 1 / b + 1 / c + 1 / d) / 4, 1) * np.minimum(odds / np.log(8), 1)
    weight[~on.any(0)] = 0.05
    v = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0) * weight * (np.log(161 / ((tf > 0).sum(0) + 1)) + 1)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    votes = []
    for i in range(160):
        cos = np.round(v[:120] @ v[i], 12)
        if i < 120:
            cos[i] = 0
        near = np.lexsort((np.arange(120), -cos))[:16]
        assert [e.cosine for e in got[i].evidence] == pytest.approx(cos[near][:5].tolist(), abs=1e-8)
        assert all(cos[e.example] == pytest.approx(e.cosine, abs=1e-8) for e in got[i].evidence)
        w = [sum(cos[j] / (1.05 - cos[j]) for j in near if y[j] == k and cos[j] > 0) for k in (0, 1)]
        votes.append(np.log((w[1] + 0.05) / (w[0] + 0.05)))
    # scores are a logistic curve of the votes, whose mean over the examples is that of Platt's targets
    votes, s = np.array(votes), np.array([got[i].score for i in range(160)])
    line = np.polyfit(votes, np.log(s / (1 - s)), 1)
    assert line[0] > 0 and np.allclose(np.polyval(line, votes), np.log(s / (1 - s)), atol=1e-6)
    n1, n0 = y.sum(), (1 - y).sum()
    assert abs((s[:120] - np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))).sum()) < 0.05


def test_one_known_word_does_not_decide_a_long_text(spark):
    """A word of toxic examples alone is toxic; among thousands that no example has it isn't."""
    rows = [(i, "vile trash" if i % 4 == 0 else f"plain text of day {i % 7}") for i in range(200)]
    rows += [(1000, "trash"), (1001, "trash " + " ".join(f"q{i}z" for i in range(10_000))), (1002, " ".join(f"q{i}z" for i in range(50)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.scores(docs, labels, F.lit(True)).where("doc_id >= 1000").collect()}
    assert got[1000].predicted == 1 and got[1001].evidence[0].cosine < 0.1 < 0.5 < got[1000].evidence[0].cosine
    assert not got[1002].evidence


def _statistics(text):
    """The statistics of `quality`, counted one character and word at a time."""
    def share(k, of):
        return float(np.log((k + 0.5) / (of - k + 0.5)))

    data, words, word = text.encode(), [], b""
    for b in data:
        if b in b" \t\n\r\x0b\x0c":
            words, word = (words + [word] if word else words), b""
        else:
            word += bytes([b])
    words = words + [word] if word else words
    lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
    upper, letters = sum(65 <= b <= 90 for b in data), sum(65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in data)
    counts = [sum(b in s for b in data) for s in (b"0123456789", b".,;:?", b"!#$%&*+/<=>@[\\]^_`{|}~", b" \t\n\r\x0b\x0c")] + [sum(b >= 128 for b in data)]
    distinct, pairs = [], []
    for i, w in enumerate(words):
        if w not in distinct:
            distinct.append(w)
        if i and (words[i - 1], w) not in pairs:
            pairs.append((words[i - 1], w))
    odd = sum(w[-1] < 128 and not chr(w[-1]).isalnum() and w[-1] not in b".,;:?!" for w in words)
    n, size = len(words), len(data)
    return [np.log1p(n), np.log1p(size / max(n, 1)), share(upper, letters), *(share(k, size) for k in counts), share(len(distinct), n), share(max((words.count(w) for w in distinct), default=0), n), share(len(pairs), max(n - 1, 0)), share(len(lines) - len({*lines}), len(lines)), np.log1p(n / max(len(lines), 1)), share(odd, n)]


TEXTS = [None, "", " \n\t ", "A", "one two two\ntwo ünïcode 10% <b>", "same line\nsame line\n\nsame line", "x" * 300, "tie tie a a, b; c! d? (e) f_ g-", "long " * 20_000 + "END."]


def test_statistics_by_brute_force():
    for text in TEXTS:
        np.testing.assert_allclose(quality.statistics(None if text is None else text.encode()), _statistics(text or ""), rtol=1e-12)


def test_quality_score_by_brute_force(spark):
    """Moments summed by tasks, shrinkage and densities of the whole query, from numpy over all rows; repeated rows, ties of labels and long texts among them."""
    rng = np.random.default_rng(6)
    made = [" ".join(rng.choice(["word", "Other", "the", "10", "fine,", "odd_"], rng.integers(3, 60))) + ("\nspam!! <x>" * int(rng.integers(1, 9)) if i % 3 == 0 else ".") for i in range(150)]
    rows = [*enumerate(made), *((200 + i, t) for i, t in enumerate(TEXTS)), (5, made[5]), (None, "lost")]
    given = [(i, int(i % 3 > 0)) for i in range(120)] + [(7, 0), (6, 1), (None, 1), (8, None), (200, 0), (201, 1), (208, 1)]
    out = quality.scores(spark.createDataFrame(rows, "doc_id int, text string").repartition(5), spark.createDataFrame(given, "doc_id int, label int"), F.coalesce(F.col("doc_id") % 11 != 0, F.lit(True)))
    truth = {}
    for i, y in given:
        if i is not None and i % 11 and y in (0, 1):
            truth[i] = max(y, truth.get(i, 0))
    x = np.array([_statistics(t or "") for _, t in rows])
    y = np.array([truth.get(i, -1) if i is not None else -1 for i, _ in rows])
    parts = [x[y == c] for c in (0, 1)]
    scatter = [np.cov(p.T, ddof=0) * len(p) for p in parts]
    pooled = sum(scatter) / sum(map(len, parts))
    dens = []
    for p, s in zip(parts, scatter, strict=True):
        cov = 0.9 * s / len(p) + 0.1 * pooled
        cov = 0.95 * cov + 0.05 * np.diag(np.maximum(np.diag(pooled), 1e-6))
        d = x - p.mean(0)
        dens.append(np.log((len(p) + 0.5) / (len(parts[0]) + len(parts[1]) + 1)) - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1])
    want = 1 / (1 + np.exp(np.clip(dens[0] - dens[1], -700, 700)))
    got = sorted((r.doc_id if r.doc_id is not None else -1, round(r.score, 7), r.predicted) for r in out.collect())
    assert got == sorted((i if i is not None else -1, round(float(s), 7), int(s >= 0.3)) for (i, _), s in zip(rows, want, strict=True))

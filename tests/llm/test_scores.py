"""Learned scores: gradients of the idea on small corpora, held-out accuracy, defined edge cases."""

import math
import random
import zlib

import numpy as np

from changelens.llm import quality, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, y string"


def corpus(n=500, seed=3):
    r = random.Random(seed)
    words = ["".join(r.choice(["ba", "ko", "li", "ne", "su", "ta"]) for _ in range(r.randint(1, 4))) for _ in range(200)]
    bad = ["zwack", "grunk", "plod", "snerk"]
    docs, labels = [], []
    for i in range(n):
        sentences = [[r.choice(words) for _ in range(r.randint(3, 12))] for _ in range(r.randint(1, 12))]
        toxic, good = int(r.random() < 0.25), int(r.random() < 0.7)
        if toxic:
            r.choice(sentences).insert(1, r.choice(bad))
        text = " ".join(" ".join(s).capitalize() + "." for s in sentences)
        if not good:
            text = text.upper().replace(" ", "!! ") if i % 2 else " | ".join(text.split()) + " |" * 9
        docs.append((i, text, "en", "s", len(text), "x"))
        labels.append((i, good, toxic))
    return docs, labels


def test_noisy_or_is_the_product_over_sentences():
    w = np.zeros(toxicity.BUCKETS)
    for f in toxicity.word_features("zwack"):
        w[f] = 2.0
    s = toxicity.Scorer(w, -3.0)
    p = lambda z: 1 / (1 + math.exp(-z))
    k = len(toxicity.word_features("zwack"))
    one = p(-3 + 2 * k)
    assert abs(s.document("Aaa bbb. Ccc! zwack, ZWACK?") - one) < 1e-12  # a sentence without a weighed word counts for nothing
    assert abs(s.document("A zwack. B zwack! a  ZWACK.") - (1 - (1 - one) ** 2)) < 1e-12  # repeats count once
    assert s.document("") == 0 and s.document("Good day to all here. " * 10_000) == 0
    text = "Fine here. A zwack there."
    (a, b, q), = s.offending(text)
    assert text[a:b] == " A zwack there" and abs(q - p(-3 + 2 * k)) < 1e-12


def test_the_gradient_is_that_of_the_loss():
    r = np.random.default_rng(2)
    bags = []
    for _ in range(12):
        sentences = [np.unique(r.integers(0, 9, r.integers(1, 5))) for _ in range(r.integers(1, 4))]
        bags.append((int(r.integers(2)), np.concatenate(sentences).astype("<i4"), np.cumsum([len(s) for s in sentences]).astype("<i4")))
    problem = toxicity.Problem(bags, np.arange(1, 8))
    w, bias, step = r.normal(0, 1, 7), -0.5, 1e-6
    _, dw, db = problem.loss(w, bias)
    value = lambda w, b: problem.loss(w, b)[0]
    for k in range(7):
        e = np.eye(7)[k] * step
        assert abs((value(w + e, bias) - value(w - e, bias)) / (2 * step) - dw[k]) < 1e-6
    assert abs((value(w, bias + step) - value(w, bias - step)) / (2 * step) - db) < 1e-6
    # the loss itself, document by document
    slow = 0.0
    for k, (y, flat, ends) in enumerate(bags):
        clean = 1.0
        for s in np.split(flat, ends[:-1]):
            own = [f for f in s if 1 <= f < 8]
            clean *= 1 - 1 / (1 + math.exp(-(bias + sum(w[f - 1] for f in own)))) if own else 1
        slow += -math.log(max(1 - clean, 1e-12) if y else clean) * problem.cost[k]
    assert abs(slow / len(bags) + 0.5 * problem.l2 * w @ w - value(w, bias)) < 1e-9


def test_toxicity_held_out(spark):
    docs, labels = corpus()
    d, lab = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(d, lab, spans=True).collect()}
    assert len(got) == len(docs)
    truth = {i: t for i, _, t in labels}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert r.predicted == (r.score >= 0.5)
    held = [i for i in got if got[i].held_out]
    assert sum(got[i].predicted == truth[i] for i in held) >= 0.95 * len(held)
    text = {x[0]: x[1] for x in docs}
    for i in held:
        for s in got[i].sentences:
            assert any(w in text[i][s.start : s.end].lower() for w in ("zwack", "grunk", "plod", "snerk"))
    assert all(bool(r.sentences) == bool(r.predicted) for r in got.values())
    kept = toxicity.drop_toxic(d, lab)
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in got if not got[i].predicted}


def test_toxicity_edge_cases(spark):
    d = spark.createDataFrame([(1, None, 1), (None, "", 2), (2, "x " * 100_000, 3), (2, "x", 4)], "doc_id long, text string, score int").selectExpr("*", "1 AS y", "2 AS at", "3 AS wanted", "4 AS held_out")
    for labels in ([], [(1, 1, 1)], [(2, 0, 0), (None, 1, 1), (3, None, None)]):
        lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        got = toxicity.toxicity(d, lab).collect()
        assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
        got = quality.quality(d, lab).collect()
        assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(d.limit(0), lab).count() == 0 and quality.quality(d.limit(0), lab).count() == 0


def test_isotonic_equals_brute_force():
    r = np.random.default_rng(1)
    for _ in range(30):
        x, y = r.integers(0, 8, 12).astype(float), r.integers(0, 2, 12).astype(float)
        knots, values = quality.isotonic(x, y)
        assert (np.diff(values) > 0).all() and (np.diff(knots) > 0).all()
        # greatest lower and least upper sets: the min-max formula on the distinct x
        ux = np.unique(x)
        fit = [max(min(y[(x >= a) & (x <= b)].mean() for b in ux if b >= u) for a in ux if a <= u) for u in ux]
        assert abs(sum(set(np.round(fit, 9))) - sum(np.round(values, 9))) < 1e-6


def test_normal_equations_sum_over_partitions(spark):
    docs, labels = corpus(300, 8)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    d = spark.createDataFrame(docs, DOCS)
    a, b = quality.train(d.repartition(1), lab), quality.train(d.repartition(7), lab)
    assert np.allclose(a.weights, b.weights, atol=1e-6)
    x = np.array([quality.statistics(t[1]) for t in docs])
    z = (x - a.basis.mean) / a.basis.spread
    inner, kernel = (a.basis(x)[:, :-1] @ a.basis(x)[:, :-1].T)[:40, :40], np.exp(-0.5 * 0.22**2 * ((z[:40, None] - z[None, :40]) ** 2).sum(-1))
    assert abs(inner - kernel).mean() < 0.08


def test_quality_held_out(spark):
    docs, labels = corpus(600, 5)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(docs, DOCS), lab).collect()}
    truth = {i: g for i, g, _ in labels}
    held = [i for i in got if got[i].held_out]
    assert {i for i in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(got[i].predicted == truth[i] for i in held) >= 0.95 * len(held)


def test_few_labels_are_calibrated_on_rows_kept_out(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word {i} and {i * i} more") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    seen, fit = [], quality.isotonic
    monkeypatch.setattr(quality, "isotonic", lambda x, y: (seen.append(len(x)), fit(x, y))[1])
    quality.train(docs, labels)
    assert 0 < seen[0] < 80  # a fourth of the 150 or so outside the held-out fold

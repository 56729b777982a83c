import math
import random
import zlib

import numpy as np
import pytest

from splatframe.llm import toxicity

from . import cases


def corpus(spark, n=1500):
    rng = random.Random(3)
    docs, labels, bad = [], [], {}
    for i in range(n):
        lines = [cases.words(rng, rng.randrange(4, 12), 150).replace(".", "") for _ in range(rng.randrange(2, 9))]
        if rng.random() < 0.25:
            k = rng.randrange(len(lines))
            lines[k] += " " + rng.choice(["vile", "rotten"]) + " thing"
            bad[i] = k
        docs.append((i, ". ".join(lines) + ".", "en", "s", 1))
        labels.append((i, int(i in bad)))
    return spark.createDataFrame(docs, cases.SCHEMA), spark.createDataFrame(labels, "doc_id bigint, toxic int"), bad


def test_learns_documents_and_locates_sentences(spark):
    docs, labels, bad = corpus(spark)
    rows = toxicity.toxicity(docs, labels).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(1500) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == (r.doc_id in bad) for r in held]) > 0.97
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    model = toxicity.train(docs, labels, lambda c: ~toxicity.held_out(c))
    found = {(r.doc_id, r.sentence.strip()) for r in toxicity.offending_sentences(docs, model).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    hits = [any(s.endswith(("vile thing", "rotten thing")) for d, s in found if d == i) for i in list(bad)[:80]]
    assert np.mean(hits) > 0.95
    assert all(s in texts[d] for d, s in found)
    kept = toxicity.keep(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.score < 0.5}


def test_score_is_noisy_or():
    model = toxicity.Model({"=bad": 2.0, "^bad": 1.0}, -1.0)
    score, n, offending, start, end = toxicity.score_text("Fine words. So bad!\nBad bad", toxicity._Weights(model), model.bias)
    ps = [1 / (1 + math.exp(-z)) for z in (-1, 2, 5)]
    assert score == pytest.approx(1 - (1 - ps[0]) * (1 - ps[1]) * (1 - ps[2])) and (n, offending, start, end) == (3, 2, 20, 27)
    assert toxicity.score_text(None, {}, 0.0) == (0.0, 0, 0, -1, -1)


def test_clean_texts_of_any_length_stay(spark):
    docs, labels, bad = corpus(spark)
    model = toxicity.train(docs, labels, lambda c: ~toxicity.held_out(c))
    clean = [s for r in docs.collect() if r.doc_id not in bad and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for s in r.text.split(". ")]
    rng = random.Random(4)
    rows = [(n, ". ".join(rng.choices(clean, k=n)), "en", "s", 1) for n in (1000, 10_000, 100_000)]
    rows += [(-n, f"{text}. W1 vile thing", *more) for n, text, *more in rows]
    long = spark.createDataFrame(rows, cases.SCHEMA)
    assert {r.doc_id for r in toxicity.keep(long, model).collect()} == {1000, 10_000, 100_000}


def test_odd_rows(spark):
    docs = cases.documents(spark)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None), (900, 1), (7, 0)], "doc_id bigint, toxic int")
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r.score == 0 for r in rows if r.doc_id in (60, 61, 62))
    assert len({r.score for r in rows if r.doc_id == 7}) == 1
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert all(r.predicted == 0 for r in toxicity.toxicity(docs, none).collect())
    assert toxicity.toxicity(cases.empty(spark), labels).count() == 0


def test_only_the_text_counts(spark):
    docs, labels, _ = corpus(spark, 400)
    other = docs.selectExpr("doc_id", "text", "'zz' lang", "'other' source", "7L n_chars")
    key = lambda df: sorted((r.doc_id, r.score) for r in toxicity.toxicity(df, labels).collect())
    assert key(docs) == key(other)


def test_query_on_the_tables(spark):
    from splatframe.llm.registry import QUERIES

    rows = {r.doc_id: r for r in QUERIES["op2_noisy_or_toxicity"](spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    held = [(rows[r.doc_id].predicted, r.toxic) for r in labels if rows[r.doc_id].held_out]
    assert np.mean([a == b for a, b in held]) > 0.95


def test_the_gradient_is_that_of_the_loss_and_the_loss_that_of_the_noisy_or():
    rng = np.random.default_rng(3)
    docs, k = [[[0, 1], [2]], [[1]], [[3, 3], [0], [2, 1]], [[3]]], 4
    y = np.array([1.0, 0.0, 1.0, 0.0])
    sentence = np.array([n for n, s in enumerate(s for d in docs for s in d) for _ in s])
    place = np.array([f for d in docs for s in d for f in s])
    doc = np.array([i for i, d in enumerate(docs) for _ in d])
    for _ in range(5):
        x = rng.normal(0, 1, k + 2)
        loss, g = toxicity.loss_and_gradient(x, y, sentence, place, doc, 0.01)
        sigmoid = lambda z: 1 / (1 + math.exp(-z))
        want = 0.005 * sum(w * w for w in x[:k])
        for d, label in zip(docs, y, strict=True):
            miss = (1 - sigmoid(x[k + 1])) * math.prod(1 - sigmoid(x[k] + sum(x[f] for f in s)) for s in d)
            want -= math.log(1 - miss if label else miss) / len(docs)
        assert loss == pytest.approx(want)
        for i in range(k + 2):
            step = np.eye(k + 2)[i] * 1e-6
            up, down = (toxicity.loss_and_gradient(x + s, y, sentence, place, doc, 0.01)[0] for s in (step, -step))
            assert g[i] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_the_fit_ends_where_no_derivative_is_left():
    docs = [[["good", "day"], ["vile", "thing"]], [["good", "thing"]], [["day"], ["rotten", "vile"]], [["nice", "day"]]] * 12
    y = np.array([1, 0, 1, 0] * 12, float)
    model = toxicity.fit(docs, y, epochs=5000, decay=1e-2)
    assert model.weights["=vile"] > 0 > model.weights["=nice"]
    names = sorted(model.weights)
    number = {f: i for i, f in enumerate(names)}
    met = [(n, number[f], i) for n, (i, s) in enumerate((i, s) for i, d in enumerate(docs) for s in d) for w in s for f in toxicity.features(w) if f in number]
    kept = sorted({n for n, _, _ in met})
    sentence, place = np.array([kept.index(n) for n, _, _ in met]), np.array([p for _, p, _ in met])
    doc = np.array([next(i for m, _, i in met if m == n) for n in kept])
    _, g = toxicity.loss_and_gradient(np.array([*(model.weights[f] for f in names), model.bias, model.leak]), y, sentence, place, doc, 1e-2)
    assert np.abs(g).max() < 1e-4


def test_the_training_sample_is_bounded_in_words(spark, monkeypatch):
    docs, labels, _ = corpus(spark, 300)
    seen = []
    monkeypatch.setattr(toxicity, "fit_words", lambda words, y: seen.append(len(words.word)) or toxicity.Model())
    for most in (10**6, 2000, 0):
        toxicity.train(docs, labels, lambda c: ~toxicity.held_out(c), max_train_words=most)
    whole, part, none = seen
    assert whole > 5000 and 1900 < part <= 2000 and not none


def test_names_that_need_quotes(spark):
    docs = spark.createDataFrame([(1, "a b", "x")], "doc_id bigint, text string, `a``b` string")
    assert toxicity.keep(docs, toxicity.Model()).first() == (1, "a b", "x")


def test_the_driver_makes_features_in_little_memory_and_gives_it_back(spark, monkeypatch):
    import tracemalloc

    rng, n = np.random.default_rng(5), 40_000
    vocabulary = [f"{''.join(map(chr, rng.integers(97, 123, 9)))}{i}" for i in range(n)]
    words = toxicity.Words(vocabulary, np.arange(n, dtype=np.int32), np.arange(n, dtype=np.int32) // 10, np.arange(n // 10, dtype=np.int32) // 20)
    y = (np.arange(n // 200) % 2).astype(float)
    made = sum(len(toxicity.features(w)) for w in vocabulary[:1000]) * n // 1000
    tracemalloc.start()
    toxicity.telling_features(words, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 90 * made  # 113 bytes a feature with all of them as numbers of Python's, 68 without
    given, back = [], toxicity._give_back
    monkeypatch.setattr(toxicity, "_give_back", lambda: given.append(1) or back())
    docs, labels, _ = corpus(spark, 50)
    toxicity.train(docs, labels, lambda c: ~toxicity.held_out(c))
    assert len(given) == 2

"""The toxicity network: gradients, windows, held-out accuracy and defined results."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from noteforge.llm import toxicity as T
from tests.llm.fixtures import DOCS, awkward, documents, words

BAD = ["grumble", "snarl", "hiss", "growl"]


def corpus(n, seed, share=0.4):
    """Documents of the words of one language; those with label 1 hold a few bad words."""
    rng, out = random.Random(seed), []
    pool = words(random.Random(0), 300)
    for i in range(n):
        text = [rng.choice(pool) for _ in range(rng.choice([5, 40, 150, 300]))]
        toxic = int(rng.random() < share)
        if toxic:
            for _ in range(rng.randint(2, 5)):
                text.insert(rng.randrange(len(text) + 1), rng.choice(BAD))
        out.append((" ".join(text), toxic))
    return out


@pytest.fixture(scope="module")
def model():
    taught = corpus(1000, 1)
    return T.fit([t for t, _ in taught], [y for _, y in taught], 0.4)


def test_gradients_against_finite_differences():
    rng = np.random.default_rng(0)
    p = T.new_params(5, 3, np.float64)
    grams, lengths = T.trigrams([b"ab", b"cde", b"f", b"ghij"])
    ids, at, c = np.array([1, 2, 0, 3]), rng.integers(0, 5, (3, 6)), rng.normal(size=3)
    at[:, 0], at[1, 4:] = np.maximum(at[:, 0], 1), 0

    def value():
        return float((T.forward(p, T.products(p, T.inputs_of(p, ids, grams, lengths)), at) * c).sum())

    x = T.inputs_of(p, ids, grams, lengths)
    table = T.products(p, x)
    logit, kept = T.forward(p, table, at, keep=True)
    g, d_table = T.backward(p, table, at, logit, kept, c)
    g |= T.input_gradients(p, ids, grams, lengths, x, d_table)
    assert g.keys() == p.keys()
    for name in p:
        flat, own = p[name].reshape(-1), g[name].reshape(-1)
        for i in [*rng.choice(len(flat), min(10, len(flat)), replace=False), int(np.abs(own).argmax())]:
            old = flat[i]
            flat[i] = old + 1e-5
            high = value()
            flat[i] = old - 1e-5
            low = value()
            flat[i] = old
            assert abs((high - low) / 2e-5 - own[i]) < 1e-7, name


def test_places_without_words_change_nothing():
    p = T.new_params(3)
    table = T.products(p, np.random.default_rng(1).normal(size=(4, T.WORD_DIM + T.CHAR_DIM)).astype(np.float32))
    short = np.array([[1, 2, 3]])
    padded = np.array([[1, 2, 3, 0, 0, 0]])
    assert np.allclose(T.forward(p, table, short), T.forward(p, table, padded), atol=1e-6)


def test_windows_cover_every_word():
    for n in [1, 5, 31, 32, 33, 48, 49, 64, 500]:
        firsts = T.windows_of(n).tolist()
        assert {i for f in firsts for i in range(f, min(n, f + T.WINDOW))} == set(range(n))
        assert all(b - a <= T.STRIDE for a, b in zip(firsts, firsts[1:])) and max(firsts) == max(0, n - T.WINDOW)


def test_held_out_accuracy(model):
    fresh = corpus(300, 2)
    scores = np.array(T.Scorer(model)([t for t, _ in fresh]))
    y = np.array([y for _, y in fresh])
    assert (scores[y == 1] >= T.THRESHOLD).mean() >= 0.9 and (scores[y == 0] < T.THRESHOLD).mean() >= 0.9


def test_the_worst_window_decides_wherever_it_stands(model):
    clean = corpus(40, 5, share=0.0)[0][0].split()
    long = (clean * 4000)[:60_000]
    score = T.Scorer(model)
    calm = score([" ".join(long)])[0]
    for at in (0, 30_000, 60_000):
        assert score([" ".join(long[:at] + BAD * 2 + long[at:])])[0] > max(calm, T.THRESHOLD)


def test_scores_do_not_depend_on_neighbours_or_memory(model, monkeypatch):
    texts = [t for t, _ in corpus(40, 6)] + [None, "", "x"]
    once = np.array(T.Scorer(model)(texts))
    alone = np.array([T.Scorer(model)([t])[0] for t in texts])
    monkeypatch.setattr(T, "REMEMBERED", 20)
    monkeypatch.setattr(T, "TOKENS", 100)
    assert np.allclose(once, alone, atol=1e-5) and np.allclose(once, T.Scorer(model)(texts), atol=1e-5)


def test_defined_results(spark, model):
    rows = awkward()
    docs = documents(spark, rows)
    got = T.with_toxicity(docs.withColumn("score", F.lit("clash")).withColumn("_toxicity", F.lit(1)), model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["_toxicity"] == 1 for r in got)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert {r["score"] for r in got if not T.words_of(r["text"])} == {0.4}
    assert T.with_toxicity(spark.createDataFrame([], DOCS), model).collect() == []


LABELS = "doc_id bigint, quality int, toxic int"


def test_training_on_tables(spark):
    texts = corpus(120, 7)
    docs = documents(spark, [(i, t) for i, (t, _) in enumerate(texts)] + [(0, "the same id"), (500, "unlabelled"), (None, "x"), (501, None)])
    marks = [(i, 1, y) for i, (_, y) in enumerate(texts)] + [(i, 0, 0) for i in range(10)] + [(3, 0, None), (None, 0, 1), (999, 1, 1), (501, 1, 0)]
    model = T.train(docs, spark.createDataFrame(marks, LABELS))
    assert model.params and abs(model.share - sum(y for _, y in texts) / 121) < 1e-9
    again = T.train(docs.repartition(5), spark.createDataFrame(marks, LABELS).repartition(4))
    assert again.words == model.words and np.allclose(again.params["out"], model.params["out"], atol=1e-4)


def test_without_labels_or_with_one_class(spark):
    docs = documents(spark, [(1, "a b c"), (2, "d e f"), (3, None)])
    none = T.train(docs, spark.createDataFrame([], LABELS))
    assert {r["score"] for r in T.with_toxicity(docs, none).collect()} == {0.0}
    ones = T.train(docs, spark.createDataFrame([(1, 0, 1), (2, 0, 1)], LABELS))
    assert {(r["score"], r["predicted"]) for r in T.with_toxicity(docs, ones).collect()} == {(1.0, 1)}
    assert T.train(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).share == 0.0

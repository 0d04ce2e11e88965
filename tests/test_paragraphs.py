"""Paragraph vectors: gradients of a cell, determinism, neighbours, new notes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from noteforge.operators import models as M
from noteforge.operators import paragraphs as P

TOPICS = {"a": "apple pear plum grape melon lemon".split(), "b": "road rail ship plane truck tram".split(), "c": "drum flute violin harp horn bell".split()}
SETTINGS = P.Settings(dim=12, passes=12, blocks=2, rate=0.1)


@pytest.fixture(scope="module")
def notes(spark):
    """Notes of one topic each, in which common words outnumber the topic's."""
    rng = random.Random(5)
    common = [f"common{i}" for i in range(30)]
    rows = []
    for i in range(90):
        label = "abc"[i % 3]
        words = [rng.choice(TOPICS[label]) for _ in range(4)] + [rng.choice(common) for _ in range(16)]
        rows.append((f"n{i:02d}", label, words))
    return spark.createDataFrame(rows, "id string, label string, tokens array<string>").repartition(3).cache()


@pytest.fixture(scope="module")
def fitted(notes):
    model, vectors = P.fit(notes, "id", SETTINGS)
    return model, {r["_key"]: np.array(r["vec"]) for r in vectors.collect()}


def agreement(vectors, labels):
    """Share of notes whose nearest other note has their label."""
    keys = sorted(vectors)
    x = np.stack([vectors[k] / max(np.linalg.norm(vectors[k]), 1e-12) for k in keys])
    near = x @ x.T - 2 * np.eye(len(keys))
    return np.mean([labels[keys[i]] == labels[keys[j]] for i, j in enumerate(near.argmax(axis=1))])


def test_neighbours_beat_the_mean_of_word_vectors(notes, fitted):
    labels = {r["id"]: r["label"] for r in notes.collect()}
    mean = M.word2vec(dim=12, parts=1).fit(notes).transform(notes).collect()
    own, plain = agreement(fitted[1], labels), agreement({r["id"]: r["vec"].toArray() for r in mean}, labels)
    assert len(fitted[1]) == 90 and own >= 0.8 and own > plain


def test_the_same_for_a_seed_whatever_the_layout(notes, fitted):
    again = {r["_key"]: np.array(r["vec"]) for r in P.fit(notes.repartition(7), "id", SETTINGS)[1].collect()}
    assert all(np.array_equal(again[k], v) for k, v in fitted[1].items())
    other = P.fit(notes, "id", P.Settings(dim=12, passes=1, blocks=2, seed=1))[1].first()["vec"]
    assert len(other) == 12 and not np.array_equal(other, fitted[1]["n00"])


def test_new_notes_and_saved_models(spark, notes, fitted, tmp_path):
    meta = fitted[0].save(str(tmp_path / "pv"))
    model = P.ParagraphVectors.load(spark, str(tmp_path / "pv"), meta)
    rows = [("x", ["apple", "plum", "pear", "melon"] * 3), ("y", ["drum", "harp", "bell", "horn"] * 3), (None, ["road"]), ("none", None), ("unknown", ["zzz"])]
    got = {r["_key"]: np.array(r["vec"]) for r in model.infer(spark.createDataFrame(rows, "id string, tokens array<string>"), "id").collect()}
    assert set(got) == {"x", "y", None, "none", "unknown"}
    labels = {r["id"]: r["label"] for r in notes.collect()}

    def votes(v):
        near = sorted(fitted[1], key=lambda k: -(fitted[1][k] @ v) / np.linalg.norm(fitted[1][k]))[:7]
        return max("abc", key=[labels[k] for k in near].count)

    assert votes(got["x"]) == "a" and votes(got["y"]) == "c"
    words = {r["word"]: np.array(r["vec"]) for r in model.word_vectors().collect()}
    assert len(words) == model.dictionary.size and np.abs(words["apple"]).max() > 0


def test_a_step_follows_the_gradient():
    """With a small rate, a pass over one pair moves both vectors along the gradient of its log likelihood."""
    rng = np.random.default_rng(0)
    notes, words = rng.normal(size=(2, 5)).astype(np.float32), rng.normal(size=(3, 5)).astype(np.float32)
    a, w = notes[1].copy(), words.copy()
    noise = np.array([0.0, 1.0, 1.0])  # always the second word
    P.train_cell(notes, words, np.array([[1, 0]]), noise, 1e-3, np.random.default_rng(1), negatives=1)

    def loss(v):
        return np.log(1 / (1 + np.exp(-v @ w[0]))) + np.log(1 / (1 + np.exp(v @ w[1])))

    g = np.array([(loss(a + 1e-3 * e) - loss(a - 1e-3 * e)) / 2e-3 for e in np.eye(5)])
    assert np.allclose((notes[1] - a) / 1e-3, g, atol=2e-2) and np.array_equal(words[2], w[2])
    assert np.abs(words[0] - w[0]).max() > 0 and np.abs(words[1] - w[1]).max() > 0


def test_block_count_bounds_blocks_and_cells():
    s = P.Settings(dim=100)
    assert P.block_count(10, 10, 10, s) == P.LEAST_BLOCKS
    n = P.block_count(10_000_000, 1_000_000, 10**9, s)
    assert 4 * 100 * 10_000_000 / n <= P.BLOCK_BYTES and 12 * 10**9 / n**2 <= P.BLOCK_BYTES

"""Word vectors that no driver holds."""

import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array

from noteforge.operators import models as M
from noteforge.operators import skipgram as G

TOPICS = [["apple", "plum", "pear", "melon"], ["drum", "harp", "bell", "horn"]]


@pytest.fixture(scope="module")
def notes(spark):
    rng = random.Random(7)
    rows = [(f"n{i}", [rng.choice(TOPICS[i % 2]) for _ in range(60)]) for i in range(200)]
    rows += [("none", []), ("null", None), (None, ["apple", None, "unseen"]), ("rare", ["once"])]
    return spark.createDataFrame(rows, "id string, tokens array<string>").repartition(5)


def vectors(model):
    return {r["word"]: np.array(r["v"]) for r in model.getVectors().select("word", vector_to_array("vector").alias("v")).collect()}


@pytest.mark.parametrize("parts, iterations, min_count", [(1, 1, 1), (3, 2, 1), (3, 1, 2)])
def test_words_of_a_topic_lie_together(notes, parts, iterations, min_count):
    got = vectors(M.word2vec(dim=16, parts=parts, iterations=iterations, min_count=min_count).fit(notes))
    assert set(got) == {w for t in TOPICS for w in t} | ({"once", "unseen"} if min_count == 1 else set())
    cos = lambda a, b: got[a] @ got[b] / np.linalg.norm(got[a]) / np.linalg.norm(got[b])
    inside = [cos(a, b) for t in TOPICS for a in t for b in t if a < b]
    across = [cos(a, b) for a in TOPICS[0] for b in TOPICS[1]]
    assert min(inside) > max(across)


def test_notes_get_the_mean_and_the_layout_does_not_matter(notes):
    model = M.word2vec(dim=8, parts=2).fit(notes)
    words = vectors(model)
    again = vectors(M.word2vec(dim=8, parts=2).fit(notes.repartition(7)))
    assert all(np.array_equal(again[w], v) for w, v in words.items())
    rows = model.transform(notes).collect()
    assert len(rows) == notes.count() and rows[0].asDict().keys() == {"id", "tokens", "vec"}
    for r in rows:
        tokens = r["tokens"] or []
        want = sum((words[w] for w in tokens if w in words), np.zeros(8)) / max(len(tokens), 1)
        assert r["vec"].toArray() == pytest.approx(want, rel=1e-4, abs=1e-5)


def test_parts_follow_from_the_tokens_and_rows_leave_no_driver(spark, notes, monkeypatch):
    """The library's estimator held all vectors on the driver: it failed there over 900,000 words of 200 numbers."""
    monkeypatch.setattr(G, "PART_TOKENS", 500)
    seen = []
    monkeypatch.setattr(G, "_dealt", lambda notes, parts, f=G._dealt: seen.append(parts) or f(notes, parts))
    fitted = G.SkipGram(dim=4).fit(notes)
    assert seen == [25] and fitted.table.count() == 10


def test_saved_features(spark, tmp_path):
    rows = [(f"n{i}", " ".join(TOPICS[i % 2]), "ab"[i % 2]) for i in range(40)]
    train = spark.createDataFrame(rows, "fname string, bow string, label string")
    fitted = M.fit_features(train, M.Spec("bow", "l2", "pv"), dim=6, window=3)
    meta = fitted.save(str(tmp_path / "f"))
    loaded = M.KEYED[meta["kind"]].load(spark, str(tmp_path / "f"), meta)
    plain, same = ({r["fname"]: r["features"] for r in M.with_vectors(f, M.with_feature(train, "bow"), "fname").collect()} for f in (fitted, loaded))
    assert plain == same and len(plain) == 40 and plain["n0"].size == 6 and M.feature_width(loaded) == 6

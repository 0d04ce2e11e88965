"""Features whose dictionary is a table."""

import random
import time
from collections import Counter

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from noteforge.operators import joins
from noteforge.operators import models as M
from noteforge.operators.dictionary import TERM_TYPE, fit_dictionary, note_terms, sparse_vector, unit_length, word_counts

NOTES = "id string, word string, tokens array<string>"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    out = [(f"n{i}", "clash", [rng.choice(words) for _ in range(rng.randint(0, 40))]) for i in range(80)]
    return out + [("hot", None, ["w0"] * 500), ("none", None, None), (None, None, ["w1", "w1", "w2", None])]


@pytest.fixture(scope="module")
def notes(spark, rows):
    return spark.createDataFrame(rows, NOTES).repartition(5)


def test_counts_and_ids(spark, rows, notes):
    every = Counter(w for _, _, t in rows for w in t or [] if w)
    docs = Counter(w for _, _, t in rows for w in set(t or []) if w)
    fitted = fit_dictionary(notes)
    got = {r["word"]: (r["id"], r["n"], r["df"]) for r in fitted.terms.collect()}
    order = sorted(every, key=lambda w: (-every[w], w))
    assert got == {w: (i, every[w], docs[w]) for i, w in enumerate(order)} and fitted.size == len(every) and fitted.notes == len(rows)
    assert [r["word"] for r in fit_dictionary(notes, vocab_size=5).terms.orderBy("id").collect()] == order[:5]
    assert word_counts(spark.createDataFrame([], NOTES)).count() == 0


@pytest.mark.parametrize("broadcast", [True, False])
def test_terms_of_notes(rows, notes, broadcast, monkeypatch):
    fitted = fit_dictionary(notes, vocab_size=20)
    ids = {r["word"]: r["id"] for r in fitted.terms.collect()}
    monkeypatch.setattr(joins, "is_small", lambda *a: broadcast)
    got = note_terms(notes, "id", fitted, "freq").collect()
    want = {key: sorted((ids[w], float(n)) for w, n in Counter(t or []).items() if w in ids) for key, _, t in rows}
    assert {r["_key"]: [tuple(t) for t in r["terms"]] for r in got} == want and len(got) == len(rows)


def test_null_and_new_notes_get_vectors(spark):
    train = spark.createDataFrame([("a", "heart valve heart"), ("b", "lung air"), (None, "lung"), ("d", None)], "fname string, bow string")
    fitted = M.fit_features(train, M.Spec("bow", "l2", "tfidf"))
    new = spark.createDataFrame([("x", "heart unseen"), (None, "air"), ("y", None), ("z", "")], "fname string, bow string")
    got = {r["fname"]: list(r["v"]) for r in M.with_vectors(fitted, M.with_feature(new, "bow"), "fname").select("fname", vector_to_array("features").alias("v")).collect()}
    assert set(got) == {"x", None, "y", "z"} and sum(got["y"]) == sum(got["z"]) == 0
    assert sum(v * v for v in got["x"]) == pytest.approx(1) and sum(x > 0 for x in got[None]) == 1


def test_term_bayes_equals_the_library(spark, notes):
    """Class shares of naive Bayes as a table against the fitted one on the same vectors."""
    from pyspark.ml.classification import NaiveBayes

    fitted = M.TableFeaturiser([], "freq")
    dictionary = fit_dictionary(notes)
    ready = M.TableFeatures(None, dictionary, "freq")
    terms = note_terms(notes, "id", dictionary, "freq").withColumn(M.LABEL, F.pmod(F.xxhash64("_key"), F.lit(3)).cast("double"))
    vectors = terms.withColumn(M.FEATURES, sparse_vector(F.col("terms"), ready.width)).cache()
    own = M.fit_classifier(vectors.withColumnRenamed("_key", "id"), "nb", 3, "id", width=ready.width)
    assert own.kind == "bayes" and fitted.weighting == "freq"
    library = NaiveBayes(labelCol=M.LABEL, featuresCol=M.FEATURES).fit(vectors).transform(vectors)
    want = {r["_key"]: list(r["p"]) for r in library.select("_key", vector_to_array("probability").alias("p")).collect()}
    for r in own.transform(vectors.withColumnRenamed("_key", "id"), "id").collect():
        assert r["probs"] == pytest.approx(want[r["id"]], abs=1e-9)


def test_top_features_of_every_kind(spark):
    rng = random.Random(1)
    rows = [(f"n{i}", " ".join([["apple", "pear"][i % 2]] * 3 + [rng.choice(["one", "two", "three"]) for _ in range(5)]), "ab"[i % 2]) for i in range(60)]
    notes = spark.createDataFrame(rows, "fname string, bow string, label string")
    for code, options in [("nb", {}), ("l2", {}), ("adaboost", {"rounds": 3}), ("rf", {"trees": 5})]:
        bundle = M.fit_bundle(notes, M.Spec("bow", code), "fname", "label", **options)
        top = M.top_features(spark, bundle, 2).where("place = 1").collect()
        names = {"a": "apple", "b": "pear"}
        assert top and all(r["word"] == names[r["class"]] if r["class"] in names else r["word"] in names.values() for r in top), code


def test_a_long_note_is_counted_in_proportion(spark):
    """The sort of a note's tokens runs once, not for each token: 200,000 tokens took hours."""
    long = spark.range(1).select(F.lit("long").alias("id"), F.transform(F.sequence(F.lit(0), F.lit(199_999)), lambda i: F.concat(F.lit("w"), i % 1000)).alias("tokens"))
    started = time.time()
    got = word_counts(long).collect()
    assert {(r["n"], r["df"]) for r in got} == {(200, 1)} and len(got) == 1000
    assert time.time() - started < 60


def test_unit_length_of_a_long_note_in_proportion(spark):
    """The norm of a note is summed once, not for each term."""
    ids = F.sequence(F.lit(0), F.lit(29_999))
    long = spark.range(1).select(F.transform(ids, lambda i: F.struct(i.alias("id"), F.lit(2.0).alias("w"))).cast(TERM_TYPE).alias("terms"))
    started = time.time()
    got = long.repartition(1).select(F.explode(unit_length(F.col("terms"))).alias("t")).agg(F.sum(F.col("t.w") * F.col("t.w"))).first()[0]
    assert got == pytest.approx(1.0) and time.time() - started < 15


def test_sorts_of_the_dictionary_step_have_no_interpreted_comparator(notes):
    """``array_sort`` calls a lambda for each comparison of two tokens; ``sort_array`` compares natively."""
    fitted = fit_dictionary(notes)
    for df in (word_counts(notes), note_terms(notes, "id", fitted, "freq")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "array_sort(" not in plan and "sort_array(" in plan

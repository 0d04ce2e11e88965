import itertools
import random

import pytest
from pyspark.sql import functions as F

from noteforge.operators import cohort as K
from noteforge.operators import features as V
from noteforge.operators import metrics as E
from noteforge.operators import tokens as T


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "true string, pred string")


def test_scores_by_hand(spark):
    preds = frame(spark, [("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")])
    r = {x["class"]: x for x in E.class_report(preds).collect()}
    assert (r["a"]["precision"], r["a"]["recall"]) == (1.0, 0.5)
    assert (r["b"]["precision"], r["b"]["recall"]) == (pytest.approx(1 / 3), 1.0)
    assert (r["c"]["precision"], r["c"]["recall"], r["c"]["f1"]) == (0.0, 0.0, 0.0)
    w = E.weighted_scores(preds).first()
    assert w["accuracy"] == 0.5 and w["recall"] == 0.5
    assert w["precision"] == pytest.approx((2 * 1 + 1 / 3) / 4)
    assert w["auc"] == pytest.approx((2 * 0.75 + (1 + 1 - 2 / 3) / 2 + 0.5) / 4)
    assert E.binary_scores(preds, "a").first()["f1"] == pytest.approx(2 / 3)


def test_scores_agree_with_spark(spark):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    rng = random.Random(3)
    rows = [(float(rng.randrange(4)), float(rng.randrange(4))) for _ in range(200)]
    df = spark.createDataFrame(rows, "true double, pred double")
    w = E.weighted_scores(df).first()
    for ours, theirs in (("accuracy", "accuracy"), ("precision", "weightedPrecision"), ("recall", "weightedRecall"), ("f1", "f1")):
        ev = MulticlassClassificationEvaluator(labelCol="true", predictionCol="pred", metricName=theirs)
        assert w[ours] == pytest.approx(ev.evaluate(df))


def test_single_class(spark):
    w = E.weighted_scores(frame(spark, [("a", "a"), ("a", "a")])).first()
    assert w["accuracy"] == 1.0 and w["f1"] == 1.0


def test_auc_against_pairs(spark):
    rng = random.Random(5)
    rows = [(c, rng.randrange(6) / 5.0, rng.randrange(2)) for c in "xy" for _ in range(60)] + [("z", 0.5, 1)]
    df = spark.createDataFrame(rows, "class string, score double, hit bigint")
    got = {r["class"]: r["auc"] for r in E.auc_by_class(df).collect()}
    for c in "xy":
        pos = [s for k, s, h in rows if k == c and h]
        neg = [s for k, s, h in rows if k == c and not h]
        wins = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
        assert got[c] == pytest.approx(wins / (len(pos) * len(neg)))
    assert got["z"] is None
    assert E.weighted_auc(df).first()["auc"] is not None


def test_fbeta(spark):
    df = spark.createDataFrame([(1.0, 0.9), (1.0, 0.2), (0.0, 1.7), (0.0, -3.0)], "y double, p double")
    r = E.fbeta(df, F.col("y"), F.col("p")).first()
    assert r["precision"] == pytest.approx(0.5, abs=1e-6) and r["recall"] == pytest.approx(0.5, abs=1e-6)
    none = E.fbeta(df.where("y = 0"), F.col("y"), F.col("p")).first()
    assert none["fbeta"] == 0.0
    with pytest.raises(ValueError):
        E.fbeta(df, F.col("y"), F.col("p"), beta=-1)


def test_best_run_breaks_ties_by_key(spark):
    df = spark.createDataFrame([(0.7, 2, 1), (0.9, 2, 2), (0.9, 1, 3)], "auc double, rep int, k int")
    assert tuple(E.best_run(df).first()) == (0.9, 1, 3)


def test_class_weights(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",), (None,)], "label string")
    assert {r["label"]: r["weight"] for r in K.class_weights(df, "label").collect()} == {"a": pytest.approx(4 / 3), "b": 4.0}
    assert {r["label"]: r["weight"] for r in K.class_weights(df, "label", True).collect()} == {"a": pytest.approx(2 / 3), "b": 2.0}
    assert K.class_names(df, "label") == ["a", "b"]


@pytest.mark.parametrize("dof,x,want", [(1, 3.841459, 0.05), (2, 5.991465, 0.05), (3, 7.814728, 0.05), (4, 9.487729, 0.05), (5, 15.08627, 0.01)])
def test_chi2_tail(spark, dof, x, want):
    df = spark.createDataFrame([(x,)], "x double")
    assert df.select(V.chi2_p_value(F.col("x"), dof)).first()[0] == pytest.approx(want, rel=1e-4)


def test_select_fdr(spark):
    values = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205, 0.212, 0.216]
    df = spark.createDataFrame([(f"w{i}", p) for i, p in enumerate(values)], "word string, p_value double")
    kept = {r["word"] for r in V.select_fdr(df, alpha=0.05).collect()}
    limit = max((p for i, p in enumerate(values, 1) if p <= 0.05 * i / len(values)))
    assert kept == {f"w{i}" for i, p in enumerate(values) if p <= limit}
    assert V.select_fdr(df, alpha=0.0001).count() == 0


def test_tfidf_has_unit_length(spark):
    notes = spark.createDataFrame([(1, ["a", "a", "b"]), (2, ["b", "c"])], "id long, tokens array<string>")
    rows = V.tfidf(T.term_counts(notes, "id"), "id", T.document_frequency(notes), 2).collect()
    for i in (1, 2):
        assert sum(r["weight"] ** 2 for r in rows if r["id"] == i) == pytest.approx(1.0)


def test_attention_weights_sum_to_one(spark):
    notes = spark.createDataFrame([(1, ["a", "b", "a", "zz"]), (2, ["b"])], "id long, tokens array<string>")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.5, -1.0])], "word string, vec array<double>")
    score = V.attention_score(F.col("vec"), [0.3, -0.2], 0.1)
    weights = V.attention_weights(notes, "id", vectors, score)
    sums = {r["id"]: r["s"] for r in weights.groupBy("id").agg(F.sum("weight").alias("s")).collect()}
    assert sums == {1: pytest.approx(1.0, abs=1e-6), 2: pytest.approx(1.0, abs=1e-6)}
    top = V.top_tokens(notes, "id", vectors, score, k=2).where("id = 1").orderBy("place").collect()
    assert [(r["word"], r["pos"]) for r in top] == [("b", 2), ("a", 1)]
    pooled = {r["id"]: r["vec"] for r in V.attention_pool(T.term_counts(notes, "id"), "id", vectors, score, 2).collect()}
    assert pooled[2] == pytest.approx([0.5, -1.0], abs=1e-6)

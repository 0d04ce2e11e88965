import random

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from noteforge.functions.text import tokens_ws
from noteforge.operators import bayes
from noteforge.operators import models as M
from noteforge.plans import jobs
from noteforge.sources.writers import feature_of
from noteforge.streaming.score import note_stream, score_stream, scored_notes

WORDS = {"heart": ["cardiac", "artery", "valve", "rhythm"], "lung": ["airway", "cough", "asthma", "oxygen"], "skin": ["rash", "itch", "lesion", "mole"]}


@pytest.fixture(scope="module")
def notes(spark):
    rng = random.Random(7)
    shared = ["patient", "visit", "today", "history"]
    rows = []
    for i in range(90):
        label = sorted(WORDS)[i % 3]
        words = [rng.choice(WORDS[label]) for _ in range(5)] + [rng.choice(shared) for _ in range(5)]
        rows.append((f"n{i:03d}", " ".join(words), f"C{i % 3}", label))
    return spark.createDataFrame(rows, "fname string, bow string, sg string, label string").repartition(2, "fname").cache()


def right(df):
    return df.agg(F.avg((F.col("pred_class") == F.col("label")).cast("int"))).first()[0]


@pytest.mark.parametrize("code,vec,options", [
    ("l1", "freq", {}), ("l2", "tfidf", {}), ("nb", "freq", {}), ("svmsgd", "tfidf", {"folds": 3}),
    ("rf", "freq", {"trees": 10}), ("adaboost", "freq", {"rounds": 8}), ("mlp", "tfidf", {"max_iter": 30}),
    ("svmrbf", "tfidf", {"folds": 2, "fourier": 64}),
])
def test_algorithms_learn_save_and_load(spark, notes, tmp_path, code, vec, options):
    bundle = M.fit_bundle(notes, M.Spec("bow", code, vec), "fname", "label", **options)
    scored = bundle.transform(notes)
    assert right(scored) > 0.8
    sums = scored.select(F.aggregate("probs", F.lit(0.0), lambda s, x: s + x).alias("s")).agg(F.min("s"), F.max("s")).first()
    assert sums[0] == pytest.approx(1.0) and sums[1] == pytest.approx(1.0)
    bundle.save(str(tmp_path / "m"), spark)
    again = M.Bundle.load(str(tmp_path / "m"), spark).transform(notes)
    assert {tuple(r) for r in again.select("fname", "pred_class").collect()} == {tuple(r) for r in scored.select("fname", "pred_class").collect()}


def test_two_classes_need_one_model(notes):
    two = notes.where("label <> 'skin'")
    bundle = M.fit_bundle(two, M.Spec("bow", "l2", "freq", balanced=True), "fname", "label")
    assert len(bundle.classifier.models) == 1 and right(bundle.transform(two)) > 0.9


def test_registry_rejects_what_it_does_not_know():
    for bad in (dict(algorithm="gbm"), dict(weighting="bm25"), dict(algorithm="nb", weighting="pv")):
        with pytest.raises(ValueError):
            M.Spec(**bad)
    with pytest.raises(ValueError):
        M.featuriser("bm25", "bow")


def test_feature_columns(notes):
    joined = M.with_feature(notes, "bow_sg").first()
    assert joined["feature_text"] == f"{joined['bow']} {joined['sg']}"
    with pytest.raises(ValueError):
        M.with_feature(notes, "bow_zz")


def test_own_tokenizer(notes):
    fitted = M.featuriser("freq", "bow", tokens_sql="split(upper({text}), ' ')").fit(notes)
    words = [r["word"] for r in fitted.dictionary.terms.collect()]
    assert words and all(w == w.upper() for w in words)


def test_tfidf_vectors_match_the_long_form(spark, notes):
    from noteforge.operators.features import tfidf
    from noteforge.operators.tokens import document_frequency, term_counts
    from noteforge.plans.inputs import content

    pipe = M.fit_features(notes, M.Spec("bow", "l2", "tfidf"))
    vocab = {r["id"]: r["word"] for r in pipe.dictionary.terms.collect()}
    rows = M.with_vectors(pipe, M.with_feature(notes, "bow"), "fname").select("fname", vector_to_array("features").alias("v")).collect()
    dense = {(r["fname"], vocab[i]): x for r in rows for i, x in enumerate(r["v"]) if x}
    tokens = notes.select("fname", content(F.col("bow")).alias("tokens"))
    long = tfidf(term_counts(tokens, "fname"), "fname", document_frequency(tokens), 90).collect()
    assert dense == {(r["fname"], r["word"]): pytest.approx(r["weight"]) for r in long}


def test_closed_form_bayes_equals_the_fitted_one(notes):
    tokens = notes.select("fname", "label", tokens_ws("bow").alias("tokens"))
    closed = bayes.nb_predict(bayes.nb_scores(tokens, tokens, "fname", "label"), "fname")
    bundle = M.fit_bundle(notes, M.Spec("bow", "nb", "freq"), "fname", "label")
    fitted = bundle.transform(notes).select("fname", F.col("pred_class").alias("want"))
    assert closed.join(fitted, "fname").where("pred <> want").count() == 0


def test_bayes_grid_covers_unknown_words(spark):
    train = spark.createDataFrame([(1, "x", ["a", "a"]), (2, "y", ["b"])], "id long, label string, tokens array<string>")
    test = spark.createDataFrame([(3, ["zz"]), (4, ["a"]), (5, [])], "id long, tokens array<string>")
    got = {(r["id"], r["class"]): r["score"] for r in bayes.nb_scores(train, test, "id", "label").collect()}
    import math

    half = math.log(0.5)
    assert len(got) == 6
    assert got[3, "x"] == got[5, "y"] == pytest.approx(half)
    assert got[4, "x"] == pytest.approx(half + math.log(3 / 4)) and got[4, "y"] == pytest.approx(half + math.log(1 / 3))


def test_train_and_score(spark, notes, tmp_path):
    labels = notes.select("fname", "label")
    result, model = jobs.train(notes.drop("label"), labels, str(tmp_path), features="bow+bow_sg", algorithms="nb+l2", reps=1, k=2, max_iter=20)
    assert result.scores.count() == 2 * 2 * 2 and result.predictions.count() == 2 * 2 * 90
    assert result.scores.agg(F.min("auc")).first()[0] > 0.8
    assert feature_of(model) == result.best.feature
    out = jobs.score(spark, model, notes, path=str(tmp_path / "scored"))
    assert out.columns == ["heart", "lung", "skin", "pred_class", "fname"] and out.count() == 90
    saved = spark.read.parquet(str(tmp_path / "result" / "freq_nb+l2_None_bow+bow_sg_1_2_score"))
    assert saved.count() == 8


def test_stream_equals_batch(spark, notes, tmp_path):
    bundle = M.fit_bundle(notes, M.Spec("bow", "nb", "freq"), "fname", "label")
    source = str(tmp_path / "in")
    notes.select("fname", "bow").repartition(3).write.parquet(source)
    stream = note_stream(spark, source, notes.select("fname", "bow").schema, files_per_batch=1)
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    score_stream(stream, bundle, "fname", out, progress).awaitTermination()
    batch = jobs.scored_columns(bundle, notes, "fname").collect()
    assert {tuple(r) for r in scored_notes(spark, out).collect()} == {tuple(r) for r in batch}
    score_stream(stream, bundle, "fname", out, progress).awaitTermination()
    assert scored_notes(spark, out).count() == 90


def test_top_features_and_history(spark, notes):
    bundle = M.fit_bundle(notes, M.Spec("bow", "l2", "freq"), "fname", "label")
    heart = M.top_features(spark, bundle, 4).where("class = 'heart'")
    assert {r["word"] for r in heart.collect()} == set(WORDS["heart"])


def test_stemmed_features_survive_saving(spark, tmp_path):
    rows = [("a", "running cats run", "x"), ("b", "cat dogs dog", "y"), ("c", "the cats", "x")]
    notes = spark.createDataFrame(rows, "fname string, bow string, label string")
    bundle = M.fit_bundle(notes, M.Spec("bow", "nb"), "fname", "label", feature_options={"stem": True})
    path = str(tmp_path / "model")
    bundle.save(path, spark)
    back = M.Bundle.load(path, spark)
    words = [r["word"] for r in back.features.dictionary.terms.collect()]
    assert sorted(words) == ["cat", "dog", "run"]
    assert back.transform(notes).where("fname = 'b'").first()["pred_class"] == "y"


def test_a_forest_keeps_the_nodes_of_its_rows(spark, monkeypatch):
    """Deep trees don't send the forest with each pass; the trees are those of a fit without kept nodes."""
    fitted, fit = [], M.RandomForestClassifier.fit
    monkeypatch.setattr(M.RandomForestClassifier, "fit", lambda self, df: fitted.append(self) or fit(self, df))
    rng = random.Random(5)
    rows = [(i, [rng.random() + i % 3, rng.random()], float(i % 3)) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, x array<double>, label_idx double").coalesce(1)
    df = df.select("id", M.array_to_vector("x").alias(M.FEATURES), M.LABEL).cache()
    kept = M.fit_classifier(df, "rf", 3, "id", trees=4).models[0]
    assert [e.getCacheNodeIds() for e in fitted] == [True]
    plain = fit(fitted[0].copy({fitted[0].cacheNodeIds: False}), df)
    tree = lambda m: m.toDebugString.split("\n", 1)[1]  # noqa: E731  without the fit's name
    assert tree(kept) == tree(plain)


def test_parts_of_a_solver(spark):
    wide = spark.range(100).repartition(64)
    most = M.FIT_TASKS * spark.sparkContext.defaultParallelism
    assert M.solver_parts(wide, 100, 50) == 1
    assert M.solver_parts(wide, 10**9, 50) == min(64, most)
    assert M.solver_parts(wide, 3 * M.FIT_PART_BYTES // 12, 50) == 3
    assert M.solver_parts(wide, 3 * M.FIT_PART_BYTES // 12, M.FIT_PART_BYTES) == 1  # each part sends a wide gradient


def test_lasso_reads_its_vectors_once(spark, sf, monkeypatch):
    """The vectors are kept and lie in few parts when the solver starts."""
    from noteforge.plans import catalog_models as C

    seen, fit = [], C.LinearRegression.fit
    monkeypatch.setattr(C.LinearRegression, "fit", lambda self, df: seen.append(
        ("InMemoryTableScan" in df._jdf.queryExecution().executedPlan().toString(), df.rdd.getNumPartitions())) or fit(self, df))
    assert C.lasso_terms(spark, sf).count() > 0
    assert seen == [(True, 1)]


def test_history_reads_its_vectors_once(spark, sf, monkeypatch):
    """As the lasso: the vectors are kept and lie in few parts when the solver starts."""
    from noteforge.plans import catalog_models as C

    seen, fit = [], C.LogisticRegression.fit
    monkeypatch.setattr(C.LogisticRegression, "fit", lambda self, df: seen.append(
        ("InMemoryTableScan" in df._jdf.queryExecution().executedPlan().toString(), df.rdd.getNumPartitions())) or fit(self, df))
    assert C.fit_history(spark, sf).count() > 0
    assert seen == [(True, 1)]

"""Language identification: held-out accuracy and defined results."""

import base64
import random

from pyspark.sql import functions as F

from noteforge.llm.common import bucket_of
from noteforge.llm.langid import Model, fit, kernel, letters, slots_of, train, with_language, SLOTS
from tests.llm.fixtures import DOCS, awkward, documents
import numpy as np


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = bucket_of("doc_id", 5) == 0
    model = train(docs.where(~held))
    out = with_language(docs.where(held), model)
    right, n = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count(F.lit(1))).first()
    assert n > 100 and right >= 0.95


def test_defined_results(spark):
    rows = awkward()
    taught = documents(spark, [(100 + i, t) for i, t in enumerate(["the cat and the dog", "the house", "el perro y el gato", "la casa"])])
    taught = taught.withColumn("lang", F.when(F.col("doc_id") < 102, "en").otherwise("es"))
    got = with_language(documents(spark, rows).withColumn("score", F.lit("clash")), train(taught)).collect()
    assert len(got) == len(rows)
    for r in got:
        unknown = r["text"] is None or not any(c.isalpha() for c in r["text"])
        assert (r["lang_pred"] == "und") == unknown
        assert 0 <= r["score"] <= 1 and (r["score"] == 0 or not unknown)


def test_without_training_rows_and_empty(spark):
    none = train(spark.createDataFrame([], DOCS))
    assert {r["lang_pred"] for r in with_language(documents(spark, [(1, "text")]), none).collect()} == {"und"}
    assert with_language(spark.createDataFrame([], DOCS), none).collect() == []


def test_kernel_and_folded_weights_agree():
    flags = np.zeros(SLOTS, bool)
    texts = ["the cat sat", "the dog ran off", "el gato negro", "el perro corre"]
    p = [slots_of(letters(t), flags) for t in texts]
    k = kernel(p, p)
    for i in range(4):
        for j in range(4):
            assert abs(k[i, j] - len(set(p[i]) & set(p[j])) / np.sqrt(len(p[i]) * len(p[j]))) < 1e-9
    model = fit(p, ["en", "en", "es", "es"], ridge=1e-3)
    assert isinstance(model, Model)
    assert [model.languages[i] for i in model.scores(p).argmax(axis=1)] == ["en", "en", "es", "es"]
    assert not flags.any()


OTHERS = {
    "zh": "在这个世界上有很多不同的语言和文化我们应该尊重它们", "ru": "В этом мире много разных языков и культур, и мы должны их уважать",
    "ar": "هذا نص باللغة العربية لاختبار النظام", "pl": "Litwo, Ojczyzno moja! ty jesteś jak zdrowie; ile cię trzeba cenić, ten tylko się dowie, kto cię stracił",
}


def test_the_floor_rejects_what_was_not_learned(spark):
    """Other scripts, random letters and base64 stay below the floor of a trained model; nearly all labelled texts above it."""
    rng = random.Random(3)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang IS NOT NULL")
    model = train(docs)
    flags = np.zeros(SLOTS, bool)
    texts = [r["text"] for r in docs.where(bucket_of("doc_id", 5) == 0).collect() if letters(r["text"])]
    known = np.array([model.known(slots_of(letters(t), flags)) for t in texts])
    assert (known >= model.floor).mean() >= 0.99
    noise = [" ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(6)) for _ in range(60)), base64.b64encode(rng.randbytes(400)).decode()]
    for t in [*OTHERS.values(), *noise]:
        assert model.known(slots_of(letters(t), flags)) < model.floor, t
    assert model.known(slots_of(letters("der die und"), flags)) >= model.floor


def test_scores_do_not_hang_on_the_language_column(spark):
    docs = documents(spark, awkward()).withColumn("_language", F.lit("kept"))
    out = with_language(docs, train(documents(spark, [(1, "the cat"), (2, "el gato")]).withColumn("lang", F.col("doc_id").cast("string"))))
    assert {r["_language"] for r in out.collect()} == {"kept"}

"""Steps whose rows, tasks or objects must not grow with a group, a batch or the input."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from noteforge.operators import attention as A
from noteforge.operators import concepts as C
from noteforge.operators import joins as J
from noteforge.operators import metrics as E
from noteforge.operators import phrases as H
from noteforge.operators import tokens as T


@pytest.mark.parametrize("how", ["inner", "left"])
def test_parted_join_equals_the_plain_one_and_shuffles_no_frequent_key(spark, how):
    rng = random.Random(5)
    left = spark.createDataFrame([(i, rng.choice(["hot", "warm", f"w{i % 40}", None, "lone"])) for i in range(400)], "id int, key string")
    table = spark.createDataFrame([("hot", 1), ("hot", 2), ("warm", 3), *[(f"w{i}", i) for i in range(30)], (None, 9)], "key string, v int")
    got = J.parted_join(left, table, "key", how, keys=10)
    want = left.join(table, "key", how)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert "_salt" not in got._jdf.queryExecution().toString()


def test_only_likely_runs_are_put_together(spark):
    """Tokens with blanks, empty and null ones find what all runs find."""
    words = ["a", "b", "c", "a b", "", None, "x", "y"]
    rng = random.Random(2)
    rows = [(f"n{i}", [rng.choice(words) for _ in range(rng.randint(0, 9))]) for i in range(80)] + [("none", None)]
    notes = spark.createDataFrame(rows, "id string, tokens array<string>")
    dictionary = spark.createDataFrame([(p, f"C{i}") for i, p in enumerate(["a", "a b", "b c a", "", "a ", "c  x", "a b c"])], "phrase string, cui string")
    columns = ["id", "start", "words", "phrase", "cui"]
    got = C.concept_match(notes, "id", dictionary).select(*columns)
    want = C.phrases(notes.where("tokens IS NOT NULL"), "id").join(dictionary, "phrase").select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 50
    unmet = spark.createDataFrame([("n", ["x", "y"] * 50)], "id string, tokens array<string>")
    assert C._likely_runs(unmet, "id", dictionary, "tokens", 3).count() == 0


def test_long_notes_are_walked_in_slices(monkeypatch):
    monkeypatch.setattr(H, "SLICE_WORDS", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array([["w"] * n if n is not None else None for n in (4, 8, None, 0, 30, 1, 2)])], ["id", "tokens"])
    parts = list(H.slices(iter([batch])))
    assert sum(p.num_rows for p in parts) == 7 and [p.column(0).to_pylist() for p in parts] == [[0, 1], [2, 3, 4], [5, 6]]


def test_stored_words_filter_before_the_count(spark):
    notes = spark.createDataFrame([("a", ["x", "x", "y", "z"]), ("b", ["q"]), ("c", None)], "doc string, tokens array<string>")
    vocab = spark.createDataFrame([("x", 5, 1), ("y", 2, 2), ("RARE", -1, 0)], "word string, n bigint, id bigint")
    got = T.fixed_term_counts(notes, "doc", vocab)
    assert sorted(map(tuple, got.collect())) == [("a", 1, 2), ("a", 2, 1)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Join")  # the join lies below


def test_the_class_does_not_filter_predictions(spark):
    preds = spark.range(60).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("true"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("pred"))
    got = E.binary_scores(preds, "a")
    r = got.first()
    assert (r["precision"], r["recall"]) == (pytest.approx(1 / 3), pytest.approx(1 / 2))
    assert "Range" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("contexts", [0, 3])
def test_loss_of_many_notes_equals_that_of_each(contexts, monkeypatch):
    shape, rng = A.Shape(4, 3, contexts), np.random.default_rng(1)
    sizes = [3, 0, 5, None, 1]
    n = [list(rng.integers(1, 4, s).astype(float)) if s is not None else None for s in sizes]
    x = [list(rng.normal(size=4 * s)) if s is not None else None for s in sizes]
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1, 2, 0, 1]), pa.array(n, pa.list_(pa.float64())), pa.array(x, pa.list_(pa.float64()))], ["y", "n", "vec"])
    params = rng.normal(size=len(shape.start(0)))
    loss = A.attention_loss(shape)
    whole = loss(batch, params)
    monkeypatch.setattr(A, "SLICE_WORDS", 4)
    each = [loss(batch.slice(i, 1), params) for i in range(5)]
    for value, slope in [loss(batch, params), (sum(e[0] for e in each), sum(e[1] for e in each))]:
        assert value == pytest.approx(whole[0]) and slope == pytest.approx(whole[1])
    step = 1e-6 * rng.normal(size=len(params))
    assert loss(batch, params + step)[0] - whole[0] == pytest.approx(whole[1] @ step, rel=1e-3)

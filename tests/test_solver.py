"""Iterative fits: the solver against a plain loop, stopping, attention's gradient, kernel features, boosting, selection."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from noteforge.operators import attention as A
from noteforge.operators import models as M
from noteforge.operators import solver as S
from noteforge.operators.selection import boost_terms


def blobs(n, seed, classes=3, width=4, spread=1.2):
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(0).normal(0, 1.5, (classes, width))
    y = rng.integers(0, classes, n)
    return y, centres[y] + rng.normal(0, spread, (n, width))


def table(spark, y, x):
    return spark.createDataFrame([(int(a), [float(v) for v in b]) for a, b in zip(y, x)], "y int, x array<double>").repartition(3)


def test_softmax_stops_where_a_plain_loop_stops(spark):
    y, x = blobs(120, 1)
    vy, vx = blobs(60, 2)
    done = S.fit_softmax(table(spark, y, x), 3, 4, table(spark, vy, vx), l2=1e-3, patience=2, steps=40)

    def mean(p, y, x):
        q = S.softmax(x @ p.reshape(3, 5)[:, :4].T + p.reshape(3, 5)[:, 4])
        return -np.log(q[np.arange(len(y)), y]).mean(), q

    def loss(p):
        value, q = mean(p, y, x)
        q[np.arange(len(y)), y] -= 1
        w = np.concatenate([np.ones((3, 4)), np.zeros((3, 1))], axis=1).ravel() * 1e-3
        return value + 0.5 * w @ (p * p), np.concatenate([q.T @ x, q.sum(axis=0)[:, None]], axis=1).ravel() / len(y) + w * p

    plain = S.improve(S.State(np.zeros(15)), loss, lambda p: mean(p, vy, vx)[0], patience=2, steps=40)
    assert [h[0] for h in done.history] == [h[0] for h in plain.history] and done.best_step == plain.best_step
    assert np.allclose([h[1:] for h in done.history], [h[1:] for h in plain.history]) and np.allclose(done.best, plain.best)
    validation = [h[2] for h in done.history]
    assert done.best_step == int(np.argmin(validation)) and (len(validation) - 1 - done.best_step == 2 or done.history[-1][1] < done.history[0][1])
    rows = S.history_table(spark, done).collect()
    assert [r["iteration"] for r in rows if r["kept"]] == [done.best_step]


def test_solver_goes_on_where_it_stood():
    def bowl(p):
        return float((p - 3) @ (np.array([1.0, 30.0]) * (p - 3))), 2 * np.array([1.0, 30.0]) * (p - 3)

    once = S.improve(S.State(np.zeros(2)), bowl, steps=12, patience=99, tolerance=0)
    twice = S.improve(S.improve(S.State(np.zeros(2)), bowl, steps=5, patience=99, tolerance=0), bowl, steps=7, patience=99, tolerance=0)
    assert np.allclose(once.best, 3, atol=1e-3) and np.allclose(once.params, twice.params) and len(once.history) == len(twice.history)


@pytest.mark.parametrize("contexts", [0, 3])
def test_attention_gradient_against_finite_differences(contexts):
    rng = np.random.default_rng(3)
    shape = A.Shape(4, 3, contexts)
    notes = [rng.normal(size=(k, 4)) for k in (5, 1, 0, 3)]
    batch = pa.RecordBatch.from_arrays([
        pa.array([0, 2, 1, 1], pa.int32()), pa.array([[float(i + 1) for i in range(len(v))] for v in notes]), pa.array([v.ravel().tolist() for v in notes])
    ], ["y", "n", "vec"])
    params = shape.start(1) + rng.normal(0, 0.3, len(shape.start(1)))
    loss = A.attention_loss(shape)
    _, slope = loss(batch, params)
    for i in range(len(params)):
        e = np.zeros(len(params))
        e[i] = 1e-6
        assert abs((loss(batch, params + e)[0] - loss(batch, params - e)[0]) / 2e-6 - slope[i]) < 1e-5


def test_attention_learns_which_words_matter(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(80):
        y = i % 2
        rows += [(f"n{i}", "signal" if y else "other", 1)] + [(f"n{i}", f"noise{j}", rng.randint(1, 3)) for j in rng.sample(range(20), 12)]
        labels.append((f"n{i}", y))
    g = np.random.default_rng(5)
    vectors = {f"noise{j}": [0.0, 0.0, *g.normal(0, 1, 4)] for j in range(20)} | {"signal": [1.0, 1.0, 0, 0, 0, 0], "other": [1.0, -1.0, 0, 0, 0, 0]}
    table_ = spark.createDataFrame([(w, [float(x) for x in v]) for w, v in vectors.items()], "word string, vec array<double>")
    counts, named = spark.createDataFrame(rows, "id string, word string, n bigint"), spark.createDataFrame([*labels, ("lost", None)], "id string, y int")
    check = named.where(F.col("id").isin([f"n{i}" for i in range(0, 80, 5)]))
    pool, state = A.fit_attention(counts, "id", named, table_, A.Shape(6, 2), check=check, steps=25, patience=5)
    losses = [h[1] for h in state.history]
    assert losses == sorted(losses, reverse=True) and losses[-1] < 0.5 * losses[0]
    p = pool.shape.split(pool.params)
    weight = {w: float(np.tanh(np.array(v) @ p["w"] + p["b"])) for w, v in vectors.items()}
    assert min(weight["signal"], weight["other"]) > np.mean([weight[f"noise{j}"] for j in range(20)])
    pooled = {r["id"]: r["vec"] for r in pool.pool(counts, "id", table_, spark.createDataFrame([("n0",), ("none",), (None,)], "id string")).collect()}
    assert set(pooled) == {"n0", "none", None} and pooled["none"] == [0.0] * 6 and any(pooled["n0"])


def test_structured_kernel_features_approximate_the_kernel():
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(40):
        places = rng.choice(3_000_000, 60, replace=False)
        if rows and rng.random() < 0.6:
            places[:40] = rows[-1][0][:40]
        v = rng.random(60)
        rows.append((np.sort(places), v / np.linalg.norm(v)))
    z = M.sparse_fourier(rows, 7, 4096, 0.7, 2048)
    worst = 0.0
    for i, (a, x) in enumerate(rows):
        for j, (b, y) in enumerate(rows[:i]):
            dot = sum(x[s] * y[t] for s, p in enumerate(a) for t in [np.searchsorted(b, p)] if t < len(b) and b[t] == p)
            want = math.exp(-0.7 * (2 - 2 * dot))
            worst = max(worst, abs(z[i] @ z[j] - want))
    assert worst < 0.1


def test_hadamard_against_the_matrix():
    h = np.array([[1.0]])
    for _ in range(4):
        h = np.block([[h, h], [h, -h]])
    x = np.random.default_rng(2).normal(size=(3, 16))
    assert np.allclose(M.hadamard(x), x @ h)


def test_boosted_terms_against_a_plain_loop(spark):
    rng = random.Random(8)
    notes = [(i, i % 3, sorted(rng.sample(range(12), 4) + ([20 + i % 3] if rng.random() < 0.7 else []))) for i in range(90)]
    frame = spark.createDataFrame([(float(y), [(t, 1.0) for t in ids]) for _, y, ids in notes], f"y double, terms {'array<struct<id:int,w:double>>'}").repartition(3)
    got = boost_terms(frame, "y", 3, rounds=5, cut_every=2)
    w = [1 / 90] * 90
    for stump in got:
        best = None
        for t in sorted({t for _, _, ids in notes for t in ids}):
            a = [sum(x for x, (_, y, ids) in zip(w, notes) if y == c and t in ids) for c in range(3)]
            b = [sum(x for x, (_, y, ids) in zip(w, notes) if y == c and t not in ids) for c in range(3)]
            e = round(sum(w) - max(a) - max(b), 9)
            if best is None or e < best[0]:
                best = (e, t, a.index(max(a)), b.index(max(b)))
        e = best[0] / sum(w)
        vote = math.log((1 - e) / max(e, 1e-10)) + math.log(2)
        assert (stump.id, stump.present, stump.absent) == best[1:] and stump.vote == pytest.approx(vote, abs=1e-6)
        w = [x * (math.exp(vote) if (best[2] if best[1] in ids else best[3]) != y else 1) for x, (_, y, ids) in zip(w, notes)]
        w = [x / sum(w) for x in w]
    assert len(got) == 5


def test_chi2_selection_is_fitted_saved_and_cross_validated(spark, tmp_path):
    from noteforge.plans import jobs

    rng = random.Random(3)
    rows = [(f"n{i}", " ".join([["apple", "pear"][i % 2]] * 4 + [f"noise{rng.randrange(30)}" for _ in range(8)]), "ab"[i % 2]) for i in range(80)]
    notes = spark.createDataFrame(rows, "fname string, bow string, label string")
    bundle = M.fit_bundle(notes, M.Spec("bow", "nb"), "fname", "label", feature_options={"select": "chi2"})
    assert {r["word"] for r in bundle.features.dictionary.terms.collect()} >= {"apple", "pear"} and bundle.features.width < 15
    bundle.save(str(tmp_path / "m"), spark)
    back = M.Bundle.load(str(tmp_path / "m"), spark)
    assert back.features.width == bundle.features.width and back.transform(notes).where("pred_class <> label").count() == 0
    result = jobs.cross_validate(notes, "fname", "label", "bow", "nb", k=2, feature_options={"select": "chi2"})
    assert result.scores.agg(F.min("accuracy")).first()[0] > 0.9
    with pytest.raises(ValueError):
        M.featuriser("hash", "bow", select="chi2", label="label")


def test_paragraph_features_in_a_bundle(spark, tmp_path):
    rng = random.Random(6)
    words = {"a": "apple pear plum grape".split(), "b": "road rail ship plane".split()}
    rows = [(f"n{i}", " ".join(rng.choice(words["ab"[i % 2]]) for _ in range(12)), "ab"[i % 2]) for i in range(60)]
    notes = spark.createDataFrame(rows, "fname string, bow string, label string")
    options = {"dim": 8, "passes": 6, "blocks": 2, "rate": 0.1}
    bundle = M.fit_bundle(notes, M.Spec("bow", "l2", "d2v"), "fname", "label", feature_options=options)
    bundle.save(str(tmp_path / "m"), spark)
    scored = M.Bundle.load(str(tmp_path / "m"), spark).transform(notes)
    assert scored.where("pred_class = label").count() > 50

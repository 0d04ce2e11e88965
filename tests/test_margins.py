import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from noteforge.operators import margins as G
from noteforge.operators import models as M
from noteforge.operators.solver import signed_steps, together

WIDTH, REG, CLASSES = 12, 1 / 300, 3


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = np.cos(rng.normal(size=(300, WIDTH)))
    x[:, 5] = 0.25  # stands still
    y = (2 * x[:, 0] + x[:, 1] + rng.normal(size=300) * 0.3 > 1.8).astype(int) + (x[:, 2] > 0.7)
    made = [(float(b), i % 3, a.tolist()) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(made, "label_idx double, fold int, x array<double>").repartition(3).cache()


def fitted(rows, machines, steps=100):
    return G.fit_machines(rows, G.blocks_of(rows, WIDTH), machines, WIDTH, REG, steps, M.MARGIN_TOLERANCE)


@pytest.mark.parametrize("balanced", [False, True])
def test_machines_are_those_of_the_library(rows, balanced):
    counts = M.class_counts(rows) if balanced else None
    machines = [G.Machine(c, f, *(M._sides(counts, c) if counts else ())) for f in (1, None) for c in (0, 2)]
    plain = rows.select(array_to_vector("x").alias(M.FEATURES), M.LABEL, "fold").cache()
    for machine, got in zip(machines, fitted(rows, machines)):
        mine = plain if machine.fold is None else plain.where(F.col("fold") != machine.fold)
        want = M.fit_binary(mine, M._margin(REG, 100), machine.target, counts)
        assert got == pytest.approx([*want.coefficients, want.intercept], rel=1e-6, abs=1e-9) and got[5] == 0.0


def test_all_folds_and_classes_share_their_passes(spark, rows, monkeypatch):
    """As many passes as the longest fit takes alone, not as all of them together; no fit of the library for each."""
    passes, sums = [], G.hinge_sums
    monkeypatch.setattr(G, "hinge_sums", lambda blocks, machines, planes: passes.append(len(machines)) or sums(blocks, machines, planes))
    monkeypatch.setattr(M.LinearSVC, "fit", lambda self, df: pytest.fail("one fit after the other"))
    df = rows.select(F.monotonically_increasing_id().alias("id"), array_to_vector("x").alias(M.FEATURES), M.LABEL).cache()
    model = M.fit_classifier(df, "svmrbf", CLASSES, "id", folds=3, fourier=32, max_iter=15)
    assert passes[0] == 4 * CLASSES and len(passes) <= 15 + 15  # steps, and what their searches ask for besides
    assert (model.models, np.shape(model.planes), len(model.sigmoids)) == ([], (CLASSES, 33), CLASSES)
    assert model.transform(df, "id").columns == [*df.columns, M.PROBS, M.PREDICTION]


def test_two_classes_have_one_plane(rows):
    two = rows.where(f"{M.LABEL} < 2").select(F.monotonically_increasing_id().alias("id"), array_to_vector("x").alias(M.FEATURES), M.LABEL).cache()
    model = M.fit_classifier(two, "svmrbf", 2, "id", folds=2, fourier=64, gamma=0.3)
    scored = model.transform(two, "id").select(F.size(M.PROBS).alias("n"), (F.col(M.PREDICTION) == F.col(M.LABEL)).cast("int").alias("hit"))
    assert np.shape(model.planes) == (1, 65) and scored.agg(F.min("n")).first()[0] == 2 and scored.agg(F.avg("hit")).first()[0] > 0.8


def test_margins_of_a_row_come_from_planes_that_did_not_see_it(rows):
    planes = np.zeros((3, 2, WIDTH + 1))
    planes[:, :, WIDTH] = [[10, 11], [20, 21], [30, 31]]
    found = G.unseen_margins(G.blocks_of(rows, WIDTH), planes).map(lambda r: tuple(r[1])).countByValue()
    assert found == {(10.0, 11.0): 100, (20.0, 21.0): 100, (30.0, 31.0): 100}


def test_sums_of_many_parts_are_added_up_in_tasks(rows, monkeypatch):
    machines, planes = [G.Machine(0, None), G.Machine(2, 1)], np.random.default_rng(4).normal(size=(2, WIDTH + 1))
    blocks = G.blocks_of(rows, WIDTH)
    here = G.hinge_sums(blocks, machines, planes)
    monkeypatch.setattr(G, "MOST_SUMS", 2)
    assert G.hinge_sums(blocks, machines, planes) == pytest.approx(here)


def test_rows_that_no_machine_can_use_are_errors(spark, rows):
    one = rows.limit(1)
    with pytest.raises(ValueError, match="no rows"):
        fitted(one, [G.Machine(0, one.first()["fold"])])
    with pytest.raises(ValueError, match="without a label"):
        fitted(rows.withColumn(M.LABEL, F.lit(None).cast("double")), [G.Machine(0, None)])
    bad = rows.withColumn("x", F.transform("x", lambda v, i: F.when(i == 3, F.lit(float("nan"))).otherwise(v)))
    with pytest.raises(Exception, match="finite"):
        fitted(bad, [G.Machine(0, None)])


def test_walks_end_where_their_losses_are_least():
    want = [np.array([1.0, -2.0]), np.array([0.0, 3.0]), np.zeros(2)]
    asked = []

    def losses(ids, params):
        asked.append(ids)
        return [(float((p - want[i]) @ (p - want[i])) + 1, 2 * (p - want[i])) for i, p in zip(ids, params)]

    ends = together([signed_steps(np.zeros(2), 100, 1e-9) for _ in want], losses)
    assert np.allclose(ends, want, atol=1e-3) and asked[0] == [0, 1, 2] and 2 not in asked[1]


def test_parts_of_kernel_features(spark):
    wide, cores = spark.range(10), spark.sparkContext.defaultParallelism
    assert M.kernel_parts(wide, 0) == M.kernel_parts(wide, 1000) == 1
    assert M.kernel_parts(wide, M.FIT_PART_BYTES) == min(8, cores)
    assert M.kernel_parts(wide, 100 * M.KERNEL_PART_BYTES // 8) == max(100, cores)

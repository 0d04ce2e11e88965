"""Operators that must give the plain answer whatever the skew."""

import random

import pytest
from pyspark.sql import functions as F

from noteforge.operators import joins as J
from noteforge.operators import ranking as R
from noteforge.operators import splits as S


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(1)
    rows = [(i, "hot" if rng.random() < 0.6 else f"k{rng.randrange(40)}", rng.randrange(9)) for i in range(3000)]
    return spark.createDataFrame(rows, "id long, key string, v int").repartition(5)


def test_global_rank(skewed):
    got = R.global_rank(skewed, [F.desc("v"), F.asc("id")]).collect()
    want = sorted(got, key=lambda r: (-r["v"], r["id"]))
    assert [r["rank"] for r in want] == list(range(1, 3001))


def test_top_ranked_both_ways(skewed, monkeypatch):
    order = [F.desc("v"), F.asc("id")]
    few = {(r["id"], r["rank"]) for r in R.top_ranked(skewed, order, 50).collect()}
    monkeypatch.setattr(R, "SINGLE_TASK_ROWS", 10)
    assert {(r["id"], r["rank"]) for r in R.top_ranked(skewed, order, 50).collect()} == few


def test_running_totals(skewed):
    got = R.running_totals(skewed, ["key"], ["id"], {"upto": F.col("v")}).collect()
    sums = {}
    for r in sorted(got, key=lambda r: r["id"]):
        sums[r["key"]] = sums.get(r["key"], 0) + r["v"]
        assert r["upto"] == sums[r["key"]]
    assert len(got) == 3000


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join(spark, skewed, how):
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("none", 4)], "key string, w int")
    want = sorted(map(tuple, skewed.join(right, "key", how).collect()), key=repr)
    got = sorted(map(tuple, J.salted_join(skewed, right, "key", how, salts=7, share=0.05).collect()), key=repr)
    assert got == want


def test_lookup_join_beyond_the_broadcast_bound(spark, skewed):
    right = spark.createDataFrame([("hot", 1), ("k1", 3)], "key string, w int")
    small = sorted(map(tuple, J.lookup_join(skewed, right, "key").collect()))
    large = sorted(map(tuple, J.lookup_join(skewed, right, "key", max_rows=1).collect()))
    assert small == large and len(small) > 1000
    assert J.is_small(right, 2) and not J.is_small(right, 1) and not J.is_small(right, 10, max_bytes=8)


def test_salted_join_plan_has_no_broadcast_of_the_table(spark, skewed):
    right = spark.createDataFrame([("hot", 1)], "key string, w int")
    plan = J.salted_join(skewed, right, "key")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_folds(skewed):
    got = S.stratified_folds(skewed, "id", "key", 5, 2).collect()
    assert len(got) == 6000 and len({(r["id"], r["rep"]) for r in got}) == 6000
    sizes = {}
    for r in got:
        sizes.setdefault((r["rep"], r["key"]), [0] * 5)[r["fold"]] += 1
    assert all(max(s) - min(s) <= 1 for s in sizes.values())
    again = {(r["id"], r["rep"], r["fold"]) for r in S.stratified_folds(skewed.repartition(3), "id", "key", 5, 2).collect()}
    assert again == {(r["id"], r["rep"], r["fold"]) for r in got}


def test_splits(skewed):
    exact = S.exact_split(skewed, "id").where("in_train")
    assert exact.count() == 2100
    assert S.complement(skewed, exact, "id").count() == 900
    strat = S.stratified_split(skewed, "id", "key")
    for r in strat.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("in_train").cast("int")).alias("t")).collect():
        assert r["t"] == int(r["n"] * 0.7 + 0.5 + 1e-9)
    share = S.hash_split(skewed, "id").where("in_train").count() / 3000
    assert 0.65 < share < 0.75


def test_split_of_nothing(skewed):
    assert S.exact_split(skewed.where("id < 0"), "id").count() == 0


def test_match_counts(spark):
    a = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    b = spark.createDataFrame([(2,), (9,)], "id long")
    assert tuple(J.match_counts(a, b, "id").first()) == (1, 2, 1)


def test_folds_and_splits_keep_rows_without_a_label(spark):
    rows = [(i, None if i % 7 == 0 else f"c{i % 3}", "text" * 50) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, label string, text string")
    got = S.stratified_folds(df, "id", "label", 5, 2).groupBy("label", "rep", "fold").count().collect()
    assert sum(r["count"] for r in got) == 400
    for label in (None, "c0", "c1", "c2"):
        for rep in (1, 2):
            sizes = [r["count"] for r in got if r["label"] == label and r["rep"] == rep]
            assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    train = S.stratified_split(df, "id", "label").where("label IS NULL AND in_train").count()
    assert train == round(0.7 * sum(r[1] is None for r in rows))


def test_salted_join_with_null_keys(spark):
    left = spark.createDataFrame([(i, None if i % 2 else "k") for i in range(50)], "id long, key string")
    right = spark.createDataFrame([("k", 1), (None, 2)], "key string, w int")
    want = sorted(map(tuple, left.join(right, "key", "left").collect()), key=repr)
    assert sorted(map(tuple, J.salted_join(left, right, "key", "left").collect()), key=repr) == want

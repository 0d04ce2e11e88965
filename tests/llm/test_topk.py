"""Exact top-k against all pairs."""

import math
import random

import pytest

from noteforge.llm.topk import integer_vectors, top_k

TABLE = "vec_id bigint, embedding array<float>, score int"


def table(spark, n, seed=1, big=False):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 3e4 if big else 1) for _ in range(12)], i) for i in range(n)]
    rows += [(n, None, 0), (n + 1, [1.0, None], 0), (n + 2, [float("nan")] * 12, 0), (n + 3, [float("inf")], 0), (n + 4, [], 0),
             (n + 5, [2.0] * 5, 0), (None, [1.0] * 12, 0), (3, rows[2][1], 0), (7, rows[2][1], 0), (0, [-1.0] * 12, 0)]
    return spark.createDataFrame(rows, TABLE)


def brute(rows, asked, k):
    out = []
    for q, v in asked:
        s = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize("n,k,block,big", [(90, 10, 16, False), (90, 10, 8192, True), (3, 10, 8192, False)])
def test_all_pairs(spark, n, k, block, big):
    vectors = integer_vectors(table(spark, n, big=big), "vec_id", "embedding")
    rows = [(r["id"], list(r["v"])) for r in vectors.collect()]
    asked = {}
    for i, v in rows:
        if i % 10 == 0:
            asked[i] = min(asked.get(i, v), v)
    from pyspark.sql import functions as F

    queries = vectors.where("id % 10 = 0").groupBy("id").agg(F.min("v").alias("v"))
    got = sorted(tuple(r) for r in top_k(vectors, queries, k=k, block=block).collect())
    assert got == brute(rows, asked.items(), k)


def test_integers(spark):
    x = spark.createDataFrame([(1, [0.5, -0.00001, 1.9999], 0)], TABLE)
    assert integer_vectors(x, "vec_id", "embedding").first()["v"] == [512, -1, math.floor(1024 * 1.9999)]


def test_empty_table(spark):
    empty = integer_vectors(spark.createDataFrame([], TABLE), "vec_id", "embedding")
    assert top_k(empty, empty.select("id", "v")).collect() == []

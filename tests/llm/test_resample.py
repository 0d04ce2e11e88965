"""Importance resampling: brute force, the exact cutoff and defined results."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from noteforge.llm.resample import nth_key, resample, weighted_median
from tests.llm.fixtures import DOCS, awkward, documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, targets, longest, buckets, least, percent, seed=2024):
    def slots(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = [0] * buckets, [0] * buckets
    for _, text in rows:
        for b in slots(text):
            s[b] += 1
    for text in targets:
        for b in slots(text):
            t[b] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + buckets) / ((x + 1) * (sum(t) + buckets)))) for x, y in zip(s, t)]
    out = []
    for doc_id, text in rows:
        own = slots(text)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], -(1 << 63) if r[0] is None else r[0], r[1]))
    for rank, r in enumerate(fit[: len(fit) * percent // 100], 1):
        r[4] = rank
    return sorted(map(repr, (tuple(r[:5]) for r in out)))


@pytest.mark.parametrize("longest,least,percent,rest", [(1, 20, 40, 1), (2, 0, 100, 3), (3, 1, 7, 10_000)])
def test_against_brute_force(spark, longest, least, percent, rest):
    rows = awkward() + [(1000 + i, t) for i, (_, t) in enumerate(awkward(2) * 3)]
    targets = ["abc dab " * 40, None, "", "東京 x1"]
    target = spark.createDataFrame([(t,) for t in targets], "text string")
    got = resample(documents(spark, rows).repartition(3), target, longest=longest, buckets=97, least_words=least, percent=percent, rest=rest)
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute(rows, targets, longest, 97, least, percent)


@pytest.mark.parametrize("rest", [1, 50])
def test_cutoff_with_many_ties(spark, rest):
    rng = random.Random(2)
    keys = [(rng.choice([-3, 0, 0, 0, 7, 10**12]), rng.choice([1, 2, -5])) for _ in range(500)]
    frame = spark.createDataFrame(keys, "a bigint, b bigint").repartition(5)
    for n in (1, 2, 250, 333, 499, 500):
        assert nth_key(frame, n, rest) == sorted(keys)[n - 1]


def test_pivot_discards_a_quarter():
    rng = random.Random(3)
    for _ in range(50):
        tasks = [sorted((rng.randint(0, 99), rng.randint(0, 9)) for _ in range(rng.randint(1, 40))) for _ in range(6)]
        pivot = weighted_median([(len(t), *t[(len(t) - 1) // 2]) for t in tasks])
        flat = [k for t in tasks for k in t]
        assert 4 * sum(k <= pivot for k in flat) >= len(flat) - 12 and 4 * sum(k >= pivot for k in flat) >= len(flat) - 12


def test_defined_results(spark):
    none = spark.createDataFrame([], "text string")
    assert resample(spark.createDataFrame([], DOCS), none).collect() == []
    docs = documents(spark, [(1, "a " * 30), (2, None), (3, "a " * 30)])
    got = {r["id"]: r for r in resample(docs, none, percent=50).collect()}
    assert sorted(r["rank"] or 0 for r in got.values()) == [0, 0, 1] and got[2]["n_features"] == 0 == got[2]["weight"]
    wide = docs.selectExpr("*", "1 AS id", "2 AS score", "3 AS rank", "4 AS _text", "5 AS bucket")
    assert sorted(resample(wide, none).collect()) == sorted(resample(docs, none).collect())


def test_draws_towards_the_target(spark):
    rng = random.Random(4)
    pool = ["red green blue", "one two three"]
    docs = documents(spark, [(i, " ".join(rng.choice(pool[i % 2].split()) for _ in range(30))) for i in range(400)])
    target = spark.createDataFrame([("one two three " * 200,)], "text string")
    drawn = resample(docs, target, buckets=64, percent=10).where(F.col("rank").isNotNull())
    assert drawn.count() == 40 and drawn.where("id % 2 = 1").count() >= 36

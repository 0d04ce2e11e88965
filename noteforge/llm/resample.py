"""Resampling of documents towards a target distribution.

Features are runs of 1 to ``LONGEST`` words (words as in :mod:`noteforge.llm.leaks`), dealt
by CRC-32 into ``BUCKETS`` buckets. A bucket's gain is the log ratio, in thousandths, of
its smoothed shares of the target and of the documents; a document's weight is the mean
gain of its features, rounded down. Gumbel noise that follows from the id and ``SEED`` is
added, and the highest scores win: a draw without replacement in proportion to exp(weight).

1. Every task counts its features in one array; the arrays are added by bucket. The gains
   are an array of ``BUCKETS`` numbers, broadcast, and a text's weight is a gather and a sum.
2. Scores are a table in the shared folder. The cutoff key is found by weighted medians of
   medians: each task holds its keys as arrays and names the median of those that remain;
   the median of these medians, weighted by what remains in the tasks, is the pivot. A
   quarter of the remaining keys at least lies on either side, so a round discards that
   share for certain (about half as a rule). The same pass that counts both sides of a
   pivot returns the medians of both. Once ``REST`` keys or fewer remain, they are sorted.
3. Rows above the cutoff key are ranked by range partitions; no task meets all of them.

A round sends three numbers for each task to the driver. Keys are (score falling, id
rising); what equal keys hold beyond the drawn number gets no rank.

Defined results: null texts and texts without a word have no features and weight 0, and
take part as any other where ``least_words`` is 0. A null id counts as an empty text in the
noise and comes first among ties. Rows that repeat an id are drawn one by one, equal keys
by fewer features. Unequal texts of one id share their noise. An empty target or table
has counts of 0. An empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteforge.llm.common import map_arrow
from noteforge.llm.leaks import WORD_BYTES
from noteforge.operators.ranking import global_rank
from noteforge.runtime import stage_table

LONGEST, BUCKETS, SEED = 1, 10_000, 2024
LEAST_WORDS, PERCENT = 20, 10
REST = 10_000  # keys that are sorted in one place
NO_ID = -(1 << 63)
REMEMBERED = 500_000  # buckets of words kept in a worker

Key = tuple[int, int]  # (minus score, id): smaller is better


class BucketOf(dict):
    """Buckets of features, remembered up to a bound."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        out = self[feature] = zlib.crc32(feature) % self.buckets
        return out


def features(text: str | None, longest: int, bucket_of: BucketOf) -> tuple[int, np.ndarray]:
    """The number of words, and the bucket of every feature."""
    words = (text or "").encode("utf-8", "replace").translate(WORD_BYTES).split()
    found = [np.fromiter(map(bucket_of.__getitem__, words), np.int32, len(words))]
    for n in range(2, longest + 1):
        runs = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
        found.append(np.fromiter(map(bucket_of.__getitem__, runs), np.int32, len(runs)))
    return len(words), np.concatenate(found)


def bucket_counts(docs: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, n)`` of all features of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        total, bucket_of = np.zeros(buckets, np.int64), BucketOf(buckets)
        for batch in batches:
            for value in batch.column(0).to_pylist():
                total += np.bincount(features(value, longest, bucket_of)[1], minlength=buckets)
        used = np.flatnonzero(total)
        yield {"bucket": used, "n": total[used]}

    rows = map_arrow(docs.select(F.col(text).cast("string")), count, "bucket bigint, n bigint")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def _as_array(counts: DataFrame, buckets: int) -> list[int]:
    out = [0] * buckets
    for bucket, n in counts.collect():  # ``buckets`` rows at most
        out[bucket] = n
    return out


def gains(source: list[int], target: list[int]) -> np.ndarray:
    """Log ratio of the smoothed shares of every bucket, in thousandths, rounded down."""
    k = len(source)
    all_source, all_target = float(sum(source) + k), float(sum(target) + k)
    ratios = ((t + 1.0) * all_source / ((s + 1.0) * all_target) for s, t in zip(source, target))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def noise(doc_id: str | None, seed: int = SEED) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text", longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """``(id, n_words, n_features, weight, score)`` of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        gain, bucket_of = sent.value, BucketOf(len(sent.value))
        for batch in batches:
            ids, names, texts = (c.to_pylist() for c in batch.columns)
            out: dict[str, list] = {"id": ids, "n_words": [], "n_features": [], "weight": [], "score": []}
            for name, value in zip(names, texts):
                words, found = features(value, longest, bucket_of)
                weight = int(gain[found].sum()) // len(found) if len(found) else 0
                out["n_words"].append(words)
                out["n_features"].append(len(found))
                out["weight"].append(weight)
                out["score"].append(weight + noise(name, seed))
            yield out

    rows = docs.select(F.col(doc_id).cast("bigint"), F.col(doc_id).cast("string").alias("_name"), F.col(text).cast("string").alias("_text"))
    return map_arrow(rows, score, "id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")


# --- selection -----------------------------------------------------------------


def _median(keys: np.ndarray) -> tuple[int, int, int]:
    """Number of keys (rows of two), and the lower median."""
    n = len(keys)
    if not n:
        return 0, 0, 0
    middle = np.lexsort((keys[:, 1], keys[:, 0]))[(n - 1) // 2]
    return n, int(keys[middle, 0]), int(keys[middle, 1])


def _less(keys: np.ndarray, pivot: Key) -> np.ndarray:
    return (keys[:, 0] < pivot[0]) | ((keys[:, 0] == pivot[0]) & (keys[:, 1] < pivot[1]))


def _between(keys: DataFrame, low: Key | None, high: Key | None) -> DataFrame:
    """Keys strictly between two, with a filter on the first number that the scan can use."""
    if low is not None:
        keys = keys.where((F.col("a") >= low[0]) & ((F.col("a") > low[0]) | (F.col("b") > low[1])))
    if high is not None:
        keys = keys.where((F.col("a") <= high[0]) & ((F.col("a") < high[0]) | (F.col("b") < high[1])))
    return keys


Side = list[tuple[int, int, int]]  # of each task: how many keys, and their median


def _sides(keys: DataFrame, pivot: Key | None) -> tuple[Side, Side, int]:
    """Numbers and medians of the keys below and above the pivot, by task, and how many equal it; without one, all are above."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        parts = [np.zeros((0, 2), np.int64)]
        parts += [np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1) for batch in batches]
        own = np.concatenate(parts)
        below = _less(own, pivot) if pivot is not None else np.zeros(len(own), bool)
        same = (own == np.array(pivot)).all(axis=1) if pivot is not None else below
        sides = [_median(own[below]), _median(own[~below & ~same]), (int(same.sum()), 0, 0)]
        rows = [(side, *s) for side, s in enumerate(sides) if s[0]]
        columns = list(zip(*rows)) or [[]] * 4
        yield dict(zip(("side", "n", "a", "b"), map(list, columns)))

    found: tuple[Side, Side, Side] = ([], [], [])
    for r in map_arrow(keys.select("a", "b"), split, "side bigint, n bigint, a bigint, b bigint").collect():  # three rows a task
        found[r["side"]].append((r["n"], r["a"], r["b"]))
    return found[0], found[1], sum(s[0] for s in found[2])


def weighted_median(side: Side) -> Key:
    """The first median at which half of the keys lie in tasks up to it."""
    total, seen = sum(n for n, _, _ in side), 0
    for a, b, n in sorted((a, b, n) for n, a, b in side):
        seen += n
        if 2 * seen >= total:
            return a, b
    raise ValueError("no keys")


def nth_key(keys: DataFrame, n: int, rest: int = REST) -> Key:
    """The ``n``-th smallest (from 1) of the keys ``(a, b)``, with repeats."""
    low, high, place = None, None, n
    _, side, _ = _sides(keys, None)
    while True:
        if sum(x[0] for x in side) <= rest:
            left = sorted(map(tuple, _between(keys, low, high).select("a", "b").collect()))  # ``rest`` at most
            return left[place - 1]
        pivot = weighted_median(side)
        below, above, same = _sides(_between(keys, low, high), pivot)
        smaller = sum(x[0] for x in below)
        if place <= smaller:
            high, side = pivot, below
        elif place <= smaller + same:
            return pivot
        else:
            low, side, place = pivot, above, place - smaller - same


def resample(
    docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", longest: int = LONGEST,
    buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED, rest: int = REST,
) -> DataFrame:
    """``(id, n_features, weight, score, rank)`` of every row of ``docs``; those not drawn have no rank."""
    source = _as_array(bucket_counts(docs, text, longest, buckets), buckets)
    wanted = _as_array(bucket_counts(target, target_text, longest, buckets), buckets)
    rows = stage_table(scored(docs, gains(source, wanted), doc_id, text, longest, seed), "resample-scores")
    fit = F.col("n_words") >= least_words
    key = [(-F.col("score")).alias("a"), F.coalesce("id", F.lit(NO_ID)).alias("b")]
    drawn = rows.where(fit).count() * percent // 100
    none = F.lit(None).cast("bigint")
    kept = ["id", "n_features", "weight", "score"]
    if not drawn:
        return rows.select(*kept, none.alias("rank"))
    a, b = nth_key(rows.where(fit).select(*key), drawn, rest)
    wins: Column = fit & ((F.col("score") > -a) | ((F.col("score") == -a) & (F.coalesce("id", F.lit(NO_ID)) <= b)))
    order = [F.desc("score"), F.coalesce("id", F.lit(NO_ID)), F.col("n_features")]
    winners = global_rank(rows.where(wins).select(*kept), order)
    placed = winners.select(*kept, F.when(F.col("rank") <= drawn, F.col("rank")).cast("bigint").alias("rank"))
    return placed.unionByName(rows.where(~wins).select(*kept, none.alias("rank")))

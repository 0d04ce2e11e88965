"""Exact top-k inner products by the three-phase uniform threshold.

Components become integers. A vector's score against a query is the sum of partial
scores over ``lists`` equal runs of coordinates, each of which ranks the candidates
in a list of its own. Queries and candidates meet in blocks.

1. Each block gathers, per query, the ``k`` best of every list with their exact
   sums, and each list's least score. Over all blocks the k-th best exact sum is a
   safe cutoff: nothing below it can be among the results.
2. The cutoff goes back to the blocks. A candidate that reaches it stands above the
   uniform threshold in at least one list: threshold of a list = its least score +
   (cutoff - sum of least scores) / lists. Blocks collect what stands above, adding
   lists until the best that the rest could give falls below the cutoff.
3. What is left is resolved exactly; each block hands on the k best of a query, and
   these are merged.

Every candidate is compared in phase 1 by list and in phase 2 by bound, so results
are exact for any data. Blocks are at most ``BLOCK`` rows by ``BLOCK`` queries.

Defined results: null vectors, and those with null or non-finite components, take no
part; so do those with a component beyond 2**53 in size, whose scores a long can't
hold, and rows without an id. Shorter vectors count as padded with zeros; an empty
vector scores 0. Equal scores rank by smaller id; rows that repeat an id are
candidates of their own, and a query leaves out every row with its id. With fewer
candidates than k, all are returned. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteforge.llm.common import chunks_of
from noteforge.runtime import stage_table

SCALE, LISTS, K, EVERY = 1024, 4, 10, 100
BLOCK = 8192
AT_ONCE = 128  # queries of a block whose scores are held at once
LARGEST = float(1 << 53)


def integer_vectors(table: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """``(id, v)`` with integer components, without the rows that take no part."""
    scaled = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * F.lit(float(scale))))

    def usable(x: Column) -> Column:
        y = x.cast("double") * F.lit(float(scale))
        return x.isNotNull() & ~F.isnan(y) & (F.abs(y) < LARGEST)

    fit = F.col(vector).isNotNull() & F.col(key).isNotNull() & F.forall(vector, usable)
    return table.where(fit).select(F.col(key).cast("bigint").alias("id"), scaled.alias("v"))


def _matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: through doubles where no sum can pass 2**53, else in longs."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    bound = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if bound < LARGEST:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _lists(width: int, lists: int) -> list[slice]:
    edges = np.linspace(0, width, lists + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def partial_scores(queries: pd.DataFrame, rows: pd.DataFrame, lists: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: its id, the ids of the other candidates, and their partial scores by list."""
    width = max([len(v) for v in queries["v"]] + [len(v) for v in rows["v"]] + [1])
    q_ids, ids = queries["id"].to_numpy(np.int64), rows["id"].to_numpy(np.int64)
    a, b = _matrix(queries["v"], width), _matrix(rows["v"], width)
    for some in chunks_of(len(q_ids), AT_ONCE):
        parts = [_product(a[some, s], b[:, s]) for s in _lists(width, lists)]
        for i, q in enumerate(q_ids[some]):
            use = np.flatnonzero(ids != q)
            if len(use):
                yield int(q), ids[use], np.stack([p[i][use] for p in parts])


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        among = np.flatnonzero(scores >= edge)
    else:
        among = np.arange(len(scores))
    return among[np.lexsort((ids[among], -scores[among]))][:k]


def _gather(queries: pd.DataFrame, rows: pd.DataFrame, lists: int, k: int) -> Iterator[dict]:
    """Phase 1: list heads with their exact sums, and the least score of each list."""
    for q, ids, partial in partial_scores(queries, rows, lists):
        heads = np.unique(np.concatenate([best(scores, ids, k) for scores in partial]))
        sums = partial[:, heads].sum(axis=0)
        yield {"q": q, "sums": sums[best(sums, ids[heads], k)].tolist(), "least": partial.min(axis=1).tolist()}


def _collect(queries: pd.DataFrame, rows: pd.DataFrame, lists: int, k: int) -> Iterator[dict]:
    """Phases 2 and 3: what can reach the cutoff, resolved exactly."""
    cutoff = dict(zip(queries["id"].tolist(), zip(queries["cut"].tolist(), queries["least"])))
    for q, ids, partial in partial_scores(queries, rows, lists):
        cut, least = int(cutoff[q][0]), np.asarray(cutoff[q][1], np.int64)
        above = (partial - least[:, None]) * lists >= cut - int(least.sum())
        left = np.flatnonzero(above.any(axis=0))
        most = partial.max(axis=1)
        for seen in range(1, lists):  # upper bound: the lists seen, and the best of the others
            left = left[partial[:seen, left].sum(axis=0) + most[seen:].sum() >= cut]
        sums = partial[:, left].sum(axis=0)
        left, sums = left[sums >= cut], sums[sums >= cut]
        for i in best(sums, ids[left], k):
            yield {"query_id": q, "vec_id": ids[left[i]], "score": int(sums[i])}


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = K, lists: int = LISTS, block: int = BLOCK
) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for ``(id, v)`` frames of integer vectors; query ids are distinct."""
    n, m = vectors.count(), queries.count()
    row_blocks, query_blocks = max(1, -(-n // block)), max(1, -(-m // block))

    def spread(df: DataFrame, own: str, own_blocks: int, other: str, other_blocks: int) -> DataFrame:
        share = F.pmod(F.xxhash64("id"), F.lit(own_blocks)).cast("int")
        meet = F.explode(F.sequence(F.lit(0), F.lit(other_blocks - 1)))
        df = df.withColumn(own, share).withColumn(other, meet)
        return df.select(*[F.col(c).alias(c) for c in df.columns])  # own columns on either side of the cogroup

    rows = spread(vectors, "rb", row_blocks, "qb", query_blocks)
    asked = spread(queries.select("id", "v"), "qb", query_blocks, "rb", row_blocks)

    def phase_1(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = list(_gather(left, right, lists, k)) if len(left) and len(right) else []
        return pd.DataFrame(found, columns=["q", "sums", "least"])

    gathered = asked.groupBy("qb", "rb").cogroup(rows.groupBy("qb", "rb")).applyInPandas(
        phase_1, "q bigint, sums array<bigint>, least array<bigint>"
    )
    # k-th best sum (the least possible, if there are fewer) and least score per list
    heads = gathered.select("q", F.explode("sums").alias("s"))
    ranked = heads.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"))))
    kth = ranked.where(F.col("r") <= k).groupBy("q").agg(F.min("s").alias("s"), F.count(F.lit(1)).alias("n"))
    least = gathered.groupBy("q").agg(F.array(*[F.min(F.col("least")[i]) for i in range(lists)]).alias("least"))
    safe = F.when(F.col("n") >= k, F.col("s")).otherwise(
        F.aggregate("least", F.lit(0).cast("bigint"), lambda a, x: a + x)
    )
    cutoff = stage_table(
        least.join(kth, "q").select(F.col("q").alias("id"), safe.alias("cut"), "least"), "topk-cutoff"
    )
    asked_again = spread(queries.join(cutoff, "id"), "qb", query_blocks, "rb", row_blocks)

    def phase_2(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = list(_collect(left, right, lists, k)) if len(left) and len(right) else []
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    result = asked_again.groupBy("qb", "rb").cogroup(rows.groupBy("qb", "rb")).applyInPandas(
        phase_2, "query_id bigint, vec_id bigint, score bigint"
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return result.withColumn("rank", place.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

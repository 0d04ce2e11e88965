"""Skip-gram word vectors, trained in parts of the notes and averaged.

Each part of the notes trains vectors of its own words from the same first vectors, and a
word's vectors are averaged over the parts, weighted by its count. The driver holds none of
them: a part returns its words as rows, one aggregate by hash of the word averages them, and
a further iteration hands every part its own words only. Parts have about ``PART_TOKENS``
tokens, so the work and the rows moved grow with the notes.

Within a part, a word tells the words around it (a window drawn from 1 to ``window`` for each
place) from words drawn by (count to the power 3/4); places are taken ``BATCH`` at a time. A
word that a batch repeats moves as far as ``REPEATS`` places would move it at most.

Defined results: first vectors follow from the word and the seed, so results depend on the
seed, the rows and the number of parts only. Notes without tokens teach nothing and have a
vector of zeros; a note's vector is the sum of its known words' vectors by its number of tokens.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, AtomicType, FloatType

from noteforge.operators.dictionary import FEATURES, word_counts
from noteforge.operators.phrases import next_node, word_hash
from noteforge.runtime import Workspace

PART_TOKENS = 2_000_000
BATCH, REPEATS = 256, 2
NEGATIVES, DRAWN, POWER = 5, 64, 0.75  # counterexamples a pair; words drawn for a batch, which share their weight
RATE, LEAST_RATE = 0.025, 1e-4
SPREAD = 4  # partitions for each part, so that parts seldom share one
POOL_TOKENS = 50_000  # gathered at a time
TRAINED = "word string, n double, vec array<float>, out array<float>"


def first_vectors(words: list[str], dim: int, seed: int) -> np.ndarray:
    """The vectors of words before training."""
    out = np.empty((len(words), dim), np.float32)
    places = np.arange(dim, dtype=np.uint64)[None]
    for at in range(0, len(words), 10_000):
        hashes = np.fromiter(map(word_hash, words[at : at + 10_000]), np.uint64)
        bits = next_node(next_node(hashes, np.uint64(seed))[:, None], places) >> np.uint64(40)
        out[at : at + 10_000] = (bits.astype(np.float64) / (1 << 24) - 0.5) / dim
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _move(rows: np.ndarray, ids: np.ndarray, steps: np.ndarray) -> None:
    distinct, place, n = np.unique(ids, return_inverse=True, return_counts=True)
    sums = np.add.reduceat(steps[np.argsort(place, kind="stable")], np.cumsum(n) - n, axis=0)
    rows[distinct] += sums * np.minimum(1, REPEATS / n).astype(np.float32)[:, None]


def train_part(ids: np.ndarray, note: np.ndarray, vectors: np.ndarray, outer: np.ndarray, window: int, rate: float, least: float,
               rng: np.random.Generator) -> None:
    """One pass over the words of a part, in place; the rate falls from ``rate`` to ``least``."""
    noise = np.cumsum(np.bincount(ids, minlength=len(vectors)) ** POWER)
    reach = rng.integers(1, window + 1, len(ids))
    for at in range(0, len(ids), BATCH):
        end = min(at + BATCH, len(ids))
        low, high = max(at - window, 0), min(end + window, len(ids))
        own, near = ids[at:end], ids[low:high]
        x, y = vectors[own], outer[near]
        dx, dy, pairs = np.zeros_like(x), np.zeros_like(y), np.zeros(len(own), np.float32)
        for d in [*range(-window, 0), *range(1, window + 1)]:
            p, q = max(at, low - d), min(end, high - d)
            if p >= q:
                continue
            i, j = slice(p - at, q - at), slice(p + d - low, q + d - low)
            met = (reach[p:q] >= abs(d)) & (note[p:q] == note[p + d : q + d])
            pull = np.where(met, 1 - _sigmoid(np.einsum("nd,nd->n", x[i], y[j])), 0).astype(np.float32)[:, None]
            dx[i] += pull * y[j]
            dy[j] += pull * x[i]
            pairs[i] += met
        drawn = np.minimum(np.searchsorted(noise, rng.random(DRAWN) * noise[-1], side="right"), len(noise) - 1)
        z = outer[drawn]
        push = -_sigmoid(x @ z.T) * (pairs * (NEGATIVES / DRAWN))[:, None]
        push[own[:, None] == drawn] = 0  # a word is no counterexample of itself
        dx += push @ z
        now = np.float32(rate + (least - rate) * at / len(ids))
        _move(vectors, own, now * dx)
        _move(outer, np.concatenate([near, drawn]), now * np.concatenate([dy, push.T @ x]))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _lists(rows: np.ndarray) -> pa.Array:
    n, dim = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), pa.array(rows.ravel(), pa.float32()))


def _flat(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """All tokens of the notes, and each note's number of them."""
    lists = column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)


def _tokens_of(notes: DataFrame) -> int:
    return notes.agg(F.coalesce(F.sum(F.greatest(F.size("tokens"), F.lit(0)).cast("bigint")), F.lit(0))).first()[0]


def _dealt(notes: DataFrame, parts: int) -> DataFrame:
    """Add ``_by`` and ``_part``: rows are dealt out by a hash of all they hold, so copies of a text spread."""
    plain = [f.name for f in notes.schema.fields if isinstance(f.dataType, AtomicType)]
    by: Column = F.xxhash64(*plain, "tokens")
    return notes.withColumn("_by", by).withColumn("_part", F.pmod(F.col("_by"), F.lit(parts)).cast("int")).repartition(SPREAD * parts, "_part")


def _asked(dealt: DataFrame, words: DataFrame, parts: int) -> DataFrame:
    """The rows of ``words`` that each part needs."""
    pairs = dealt.select(F.col("_part").alias("_at"), F.explode_outer(F.array_distinct("tokens")).alias("word")).where(F.col("word").isNotNull()).distinct()
    return pairs.join(words, "word").repartition(SPREAD * parts, "_at")


@dataclass(frozen=True)
class SkipGram:
    """An estimator of word vectors over ``tokens``."""

    dim: int = 300
    window: int = 5
    min_count: int = 1
    parts: int | None = None
    iterations: int = 1
    seed: int = 42
    output: str = "vec"

    def fit(self, notes: DataFrame) -> WordVectors:
        spark = notes.sparkSession
        work = Workspace(spark, "skipgram")
        parts = self.parts or max(spark.sparkContext.defaultParallelism, math.ceil(_tokens_of(notes) / PART_TOKENS))
        dealt = _dealt(notes, parts).select("_part", "_by", "tokens")
        state = None
        if self.min_count > 1:
            none = F.lit(None).cast("array<float>")
            state = work.put(word_counts(notes).where(F.col("n") >= self.min_count).select("word", none.alias("vec"), none.alias("out")), "words")
        for turn in range(self.iterations):
            groups = dealt.groupBy("_part")
            if state is None:
                trained = groups.applyInArrow(self._trainer(turn), TRAINED)
            else:
                trained = groups.cogroup(_asked(dealt, state, parts).groupBy("_at")).applyInArrow(self._trainer(turn, True), TRAINED)
            state = work.put(self._averaged(trained, parts), "words")
        return WordVectors(state.select("word", "vec"), self.dim, self.output)

    def _trainer(self, turn: int, known: bool = False):
        s = self
        rate, least = (max(RATE * (1 - t / s.iterations), RATE * LEAST_RATE) for t in (turn, turn + 1))

        def run(rows: pa.Table, given: pa.Table | None) -> pa.Table:
            rows = rows.sort_by("_by")
            flat, sizes = _flat(rows["tokens"])
            note = np.repeat(np.arange(len(sizes)), sizes)
            if given is None:
                coded = flat.dictionary_encode()
                words, place = coded.dictionary, coded.indices
                vectors, outer = first_vectors(words.to_pylist(), s.dim, s.seed), np.zeros((len(words), s.dim), np.float32)
            else:
                given = given.sort_by("word")
                words = given["word"].combine_chunks()
                place = pc.index_in(flat, value_set=words)
                fresh = given["vec"].null_count > 0
                vectors = first_vectors(words.to_pylist(), s.dim, s.seed) if fresh else _matrix(given["vec"], s.dim).copy()
                outer = np.zeros((len(words), s.dim), np.float32) if fresh else _matrix(given["out"], s.dim).copy()
            kept = place.is_valid().to_numpy(zero_copy_only=False)
            ids = pc.fill_null(place, 0).to_numpy(zero_copy_only=False).astype(np.int64)[kept]
            part = rows["_part"][0].as_py() if rows.num_rows else 0
            if len(ids):
                train_part(ids, note[kept], vectors, outer, s.window, rate, least, np.random.default_rng([s.seed, turn, part]))
            n = np.bincount(ids, minlength=len(words)).astype(np.float64)
            left = _lists(outer) if turn + 1 < s.iterations else pa.nulls(len(words), pa.list_(pa.float32()))  # nothing reads the last ones
            return pa.table({"word": words.cast(pa.string()), "n": pa.array(n), "vec": _lists(vectors), "out": left})

        if known:
            return lambda rows, given: run(rows, given)
        return lambda rows: run(rows, None)

    def _averaged(self, trained: DataFrame, parts: int) -> DataFrame:
        """``(word, vec, out)``: the parts' vectors of each word, in groups of a part's size."""
        dim = self.dim

        def mean(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by([("word", "ascending"), ("n", "ascending")])
            runs = pc.run_end_encode(rows["word"].combine_chunks())
            ends = runs.run_ends.to_numpy()
            starts = np.concatenate([[0], ends[:-1]])
            n = rows["n"].to_numpy()
            share = (n / np.repeat(np.add.reduceat(n, starts), ends - starts)).astype(np.float32)[:, None]
            mean_of = lambda c: _lists(np.add.reduceat(share * _matrix(rows[c], dim), starts, axis=0))
            out = pa.nulls(len(ends), pa.list_(pa.float32())) if rows["out"].null_count else mean_of("out")
            return pa.table({"word": runs.values, "vec": mean_of("vec"), "out": out})

        bucket = F.pmod(F.xxhash64("word"), F.lit(SPREAD * parts)).cast("int")
        dealt = trained.withColumn("_b", bucket).repartition(SPREAD * parts, "_b")
        return dealt.groupBy("_b").applyInArrow(lambda rows: mean(rows.drop_columns(["_b"])), "word string, vec array<float>, out array<float>")


@dataclass(frozen=True)
class WordVectors:
    """Trained vectors ``(word, vec)`` as a table."""

    table: DataFrame
    dim: int
    output: str = "vec"

    def getVectors(self) -> DataFrame:  # noqa: N802  as the library names it
        return self.table.select("word", array_to_vector(F.col("vec").cast("array<double>")).alias("vector"))

    def transform(self, notes: DataFrame) -> DataFrame:
        """Add the mean vector of each note's ``tokens``. A part of the notes gets the vectors of its own words."""
        dim, own = self.dim, notes.columns
        parts = max(notes.sparkSession.sparkContext.defaultParallelism, math.ceil(_tokens_of(notes) / PART_TOKENS))
        dealt = _dealt(notes, parts)
        schema = notes.schema.add("_mean", ArrayType(FloatType()))

        def pool(rows: pa.Table, given: pa.Table) -> pa.Table:
            flat, sizes = _flat(rows["tokens"])
            vectors = np.concatenate([_matrix(given["vec"], dim), np.zeros((1, dim), np.float32)])
            place = pc.fill_null(pc.index_in(flat, value_set=given["word"].combine_chunks()), len(vectors) - 1).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            sums = np.zeros((len(sizes), dim), np.float32)
            some = np.flatnonzero(sizes)
            first = 0
            while first < len(some):
                begin = ends[some[first]] - sizes[some[first]]
                last = max(first + 1, int(np.searchsorted(ends[some], begin + POOL_TOKENS, side="right")))
                mine = some[first:last]
                sums[mine] = np.add.reduceat(vectors[place[begin : ends[mine[-1]]]], ends[mine] - sizes[mine] - begin, axis=0)
                first = last
            return rows.select(own).append_column("_mean", _lists(sums / np.maximum(sizes, 1)[:, None].astype(np.float32)))

        groups = dealt.groupBy("_part").cogroup(_asked(dealt, self.table, parts).groupBy("_at"))
        pooled = groups.applyInArrow(pool, schema)
        return pooled.select(*own, array_to_vector(F.col("_mean").cast("array<double>")).alias(self.output))


@dataclass(frozen=True)
class WordFeatures:
    """Fitted features: a tokenizer (a projection) and word vectors, whose mean is a note's vector."""

    tokenizer: PipelineModel
    words: WordVectors

    @property
    def width(self) -> int:
        return self.words.dim

    def transform(self, notes: DataFrame, key: str) -> DataFrame:
        """Add ``features``."""
        return self.words.transform(self.tokenizer.transform(notes)).select(*notes.columns, FEATURES)

    def save(self, path: str) -> dict:
        self.tokenizer.write().overwrite().save(f"{path}/tokenizer")
        self.words.table.write.mode("overwrite").parquet(f"{path}/words")
        return {"kind": "words", "dim": self.words.dim}

    @classmethod
    def load(cls, spark: SparkSession, path: str, meta: dict) -> WordFeatures:
        vectors = WordVectors(spark.read.parquet(f"{path}/words"), meta["dim"], FEATURES)
        return cls(PipelineModel.load(f"{path}/tokenizer"), vectors)


@dataclass(frozen=True)
class WordFeaturiser:
    """Fits :class:`WordFeatures`: ``stages`` add ``tokens``."""

    stages: list
    skipgram: SkipGram

    def fit(self, notes: DataFrame) -> WordFeatures:
        tokenizer = Pipeline(stages=self.stages).fit(notes)
        fitted = self.skipgram.fit(tokenizer.transform(notes).select("tokens", *[c for c, kind in notes.dtypes if kind != "string"]))
        return WordFeatures(tokenizer, fitted)

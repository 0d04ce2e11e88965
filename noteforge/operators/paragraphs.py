"""Paragraph vectors by negative sampling, trained on rotating blocks.

A note's vector and its words' vectors are trained so that their product tells the note's
words from words drawn by (count to the power 3/4). Notes and words are dealt into ``blocks``
blocks each; the counts of a note block and a word block are a cell. A pass over the corpus
has as many steps as there are blocks: in step s, note block b meets word block b + s, so no
two cells of a step touch the same vector, and all of them are trained side by side, each in
its own task. Negative words come from the cell's word block.

Blocks are rows of tables in the shared folder: no task and no driver holds the whole model,
and a lost task repeats one cell. The number of blocks follows from the bytes of vectors and
cells. Results depend on the seed and the blocks only: cells are sorted, and every cell of
every step has a random generator of its own.

Defined results: a note without known words keeps its first vector, which follows from its
rank and the seed. ``key`` names a note; null is a name as any other. Vectors of new notes are
trained in the same way while the words' vectors stay as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteforge.operators.dictionary import FEATURES, Dictionary, fit_dictionary
from noteforge.operators.joins import lookup_join
from noteforge.operators.ranking import global_rank
from noteforge.runtime import Workspace

DIM, PASSES, RATE, NEGATIVES, BATCH = 100, 20, 0.05, 5, 128
BLOCK_BYTES = 16 << 20  # vectors of a block; pairs of a cell
LEAST_BLOCKS = 2
POWER = 0.75
NOTES, WORDS = 0, 1


@dataclass(frozen=True)
class Settings:
    dim: int = DIM
    passes: int = PASSES
    rate: float = RATE
    negatives: int = NEGATIVES
    seed: int = 42
    blocks: int = 0  # 0: from the sizes


def first_vectors(block: int, blocks: int, size: int, s: Settings) -> np.ndarray:
    """The vectors of a note block before training."""
    rng = np.random.default_rng([s.seed, block, blocks])
    return ((rng.random((size, s.dim)) - 0.5) / s.dim).astype(np.float32)


def train_cell(notes: np.ndarray, words: np.ndarray, pairs: np.ndarray, noise: np.ndarray, rate: float, rng: np.random.Generator,
               negatives: int = NEGATIVES, frozen: bool = False) -> None:
    """One pass over the pairs (note, word) of a cell, in place. ``noise`` are the running sums of the words' shares."""
    pairs = pairs[rng.permutation(len(pairs))]
    for at in range(0, len(pairs), BATCH):
        i, j = pairs[at : at + BATCH].T
        drawn = np.searchsorted(noise, rng.random((len(i), negatives)) * noise[-1], side="right")
        others = np.minimum(drawn, len(noise) - 1)
        met = np.concatenate([j[:, None], others], axis=1)
        truth = np.zeros(met.shape, np.float32)
        truth[:, 0] = 1
        truth[:, 1:][others == j[:, None]] = np.nan  # the word itself is no counterexample
        a, w = notes[i], words[met]
        error = truth - 1 / (1 + np.exp(-np.clip(np.einsum("nd,nkd->nk", a, w), -30, 30)))
        step = (rate * np.nan_to_num(error)).astype(np.float32)
        np.add.at(notes, i, np.einsum("nk,nkd->nd", step, w))
        if not frozen:
            np.add.at(words, met.ravel(), (step[:, :, None] * a[:, None, :]).reshape(-1, a.shape[1]))


# --- tables --------------------------------------------------------------------


def _counts(notes: DataFrame, key: str, dictionary: Dictionary, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """``(number, _key)`` of the notes, and ``(number, id, n)`` of their known words."""
    keys = global_rank(notes.select(F.col(key).alias("_key")).distinct(), ["_key"], "number")
    keys = work.put(keys.select("_key", (F.col("number") - 1).alias("number")), "keys")
    words = notes.select(F.col(key).alias("_key"), F.explode("tokens").alias("word"))
    counts = words.groupBy("_key", "word").agg(F.count(F.lit(1)).alias("n"))
    known = lookup_join(counts, dictionary.terms.select("word", "id"), "word", spread_by=["_key"], staged=True)
    # a null key matches itself
    return keys, known.join(keys.withColumnRenamed("_key", "_k"), F.col("_key").eqNullSafe(F.col("_k"))).select("number", "id", "n")


def _cells(counts: DataFrame, blocks: int, work: Workspace) -> DataFrame:
    """``(nb, wb, data)``: the pairs of each cell as rows (note, word, count) of places in their blocks, sorted."""

    def pack(rows: pa.Table) -> pa.Table:
        number, word, n = (rows[c].to_numpy() for c in ("number", "id", "n"))
        order = np.lexsort((word, number))
        data = np.stack([number // blocks, word // blocks, n], axis=1)[order].astype(np.int32)
        return pa.table({"nb": pa.array([number[0] % blocks], pa.int64()), "wb": pa.array([word[0] % blocks], pa.int64()), "data": pa.array([data.tobytes()], pa.binary())})

    dealt = counts.select((F.col("number") % blocks).alias("nb"), (F.col("id") % blocks).cast("bigint").alias("wb"), "number", F.col("id").cast("bigint").alias("id"), "n")
    return work.put(dealt.groupBy("nb", "wb").applyInArrow(pack, "nb bigint, wb bigint, data binary"), "cells")


def _word_blocks(dictionary: Dictionary, blocks: int, dim: int, work: Workspace) -> DataFrame:
    """``(wb, noise, vec)``: running sums of the drawing shares, and vectors of zeros."""

    def pack(rows: pa.Table) -> pa.Table:
        ids, n = rows["id"].to_numpy(), rows["n"].to_numpy()
        n = n[np.argsort(ids)].astype(np.float64)
        zeros = np.zeros((len(n), dim), np.float32)
        return pa.table({"wb": pa.array([ids[0] % blocks], pa.int64()), "noise": pa.array([np.cumsum(n**POWER).tobytes()], pa.binary()), "vec": pa.array([zeros.tobytes()], pa.binary())})

    rows = dictionary.terms.select((F.col("id") % blocks).cast("bigint").alias("b"), F.col("id").cast("bigint").alias("id"), F.col("n").cast("bigint").alias("n"))
    return work.put(rows.groupBy("b").applyInArrow(pack, "wb bigint, noise binary, vec binary"), "words")


def _note_blocks(spark: SparkSession, notes: int, blocks: int, s: Settings, work: Workspace) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column(0).to_pylist():
                size = (notes - b + blocks - 1) // blocks
                data = first_vectors(b, blocks, max(size, 0), s).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([data], pa.binary())], ["nb", "vec"])

    return work.put(spark.range(blocks, numPartitions=blocks).mapInArrow(make, "nb bigint, vec binary"), "notes")


def _matrix(data: bytes | None, dim: int) -> np.ndarray:
    return np.frombuffer(data, np.float32).reshape(-1, dim).copy() if data else np.zeros((0, dim), np.float32)


def _step(cells: DataFrame, notes: DataFrame, words: DataFrame, blocks: int, step: int, rate: float, s: Settings, turn: int, frozen: bool) -> DataFrame:
    """``(kind, block, vec)`` of all blocks after one step."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for nb, wb, a, noise, w, data in zip(*(c.to_pylist() for c in batch.columns)):
                vectors, others = _matrix(a, s.dim), _matrix(w, s.dim)
                if data is not None and w is not None:
                    rows = np.frombuffer(data, np.int32).reshape(-1, 3)
                    pairs = np.repeat(rows[:, :2], rows[:, 2], axis=0)
                    train_cell(vectors, others, pairs, np.frombuffer(noise), rate, np.random.default_rng([s.seed, turn, nb, wb]), s.negatives, frozen)
                out = [pa.array([NOTES, WORDS], pa.int32()), pa.array([nb, wb], pa.int64()), pa.array([vectors.tobytes(), others.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(out, ["kind", "block", "vec"])

    met = notes.withColumn("wb", (F.col("nb") + step) % blocks).withColumnRenamed("vec", "a")
    met = met.join(words.select("wb", "noise", F.col("vec").alias("w")), "wb", "left").join(cells, ["nb", "wb"], "left")
    # one row for each cell: dealt out evenly, a task each
    return met.select("nb", "wb", "a", "noise", "w", "data").repartition(blocks).mapInArrow(train, "kind int, block bigint, vec binary")


def _passes(cells: DataFrame, notes: DataFrame, words: DataFrame, blocks: int, s: Settings, work: Workspace, frozen: bool) -> tuple[DataFrame, DataFrame]:
    steps = s.passes * blocks
    noise = words.select("wb", "noise")
    for turn in range(steps):
        rate = s.rate * max(1 - turn / steps, 0.02)
        done = work.put(_step(cells, notes, words, blocks, turn % blocks, rate, s, turn, frozen), "step")
        notes = done.where(F.col("kind") == NOTES).select(F.col("block").alias("nb"), "vec")
        if not frozen:
            words = done.where(F.col("kind") == WORDS).select(F.col("block").alias("wb"), "vec").join(noise, "wb").select("wb", "noise", "vec")
    return notes, words


def _unpacked(blocks_table: DataFrame, blocks: int, dim: int) -> DataFrame:
    """``(number, vec)``: one row for each vector of the blocks ``(b, vec)``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, data in zip(*(c.to_pylist() for c in batch.columns)):
                values = _matrix(data, dim).ravel()
                n = len(values) // dim
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), pa.array(values, pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n) * blocks + b, pa.int64()), lists], ["number", "vec"])

    return blocks_table.mapInArrow(rows, "number bigint, vec array<float>")


def block_count(notes: int, words: int, pairs: int, s: Settings) -> int:
    """So many blocks that no block and no cell of even size is larger than ``BLOCK_BYTES``."""
    vectors = 4 * s.dim * max(notes, words)
    return s.blocks or max(LEAST_BLOCKS, math.ceil(vectors / BLOCK_BYTES), math.ceil(math.sqrt(12 * pairs / BLOCK_BYTES)))


@dataclass(frozen=True)
class ParagraphVectors:
    """Trained word vectors as a table of blocks, and their dictionary."""

    dictionary: Dictionary
    words: DataFrame
    blocks: int
    settings: Settings

    def infer(self, notes: DataFrame, key: str) -> DataFrame:
        """``(_key, vec)`` of new notes ``(key, tokens)``; the words' vectors stay."""
        work = Workspace(notes.sparkSession, "paragraphs")
        keys, counts = _counts(notes, key, self.dictionary, work)
        cells = _cells(counts, self.blocks, work)
        start = _note_blocks(notes.sparkSession, keys.count(), self.blocks, self.settings, work)
        trained, _ = _passes(cells, start, self.words, self.blocks, self.settings, work, frozen=True)
        return _named(trained, keys, self.blocks, self.settings.dim)

    def word_vectors(self) -> DataFrame:
        """``(word, vec)``."""
        rows = _unpacked(self.words.select("wb", "vec"), self.blocks, self.settings.dim)
        return rows.join(self.dictionary.terms.select("word", F.col("id").cast("bigint").alias("number")), "number").select("word", "vec")

    def save(self, path: str) -> dict:
        self.dictionary.save(f"{path}/dictionary")
        self.words.write.mode("overwrite").parquet(f"{path}/words")
        s = self.settings
        return {"size": self.dictionary.size, "notes": self.dictionary.notes, "blocks": self.blocks,
                "settings": {"dim": s.dim, "passes": s.passes, "rate": s.rate, "negatives": s.negatives, "seed": s.seed, "blocks": s.blocks}}

    @classmethod
    def load(cls, spark: SparkSession, path: str, meta: dict) -> ParagraphVectors:
        dictionary = Dictionary.load(spark, f"{path}/dictionary", meta["size"], meta["notes"])
        return cls(dictionary, spark.read.parquet(f"{path}/words"), meta["blocks"], Settings(**meta["settings"]))


def _named(blocks_table: DataFrame, keys: DataFrame, blocks: int, dim: int) -> DataFrame:
    return _unpacked(blocks_table, blocks, dim).join(keys, "number").select("_key", "vec")


def fit(notes: DataFrame, key: str, settings: Settings = Settings(), vocab_size: int | None = None) -> tuple[ParagraphVectors, DataFrame]:
    """A trained model, and ``(_key, vec)`` of the notes ``(key, tokens)`` it was trained on."""
    spark = notes.sparkSession
    work = Workspace(spark, "paragraphs")
    dictionary = fit_dictionary(notes, vocab_size=vocab_size)
    keys, counts = _counts(notes, key, dictionary, work)
    counts = work.put(counts, "counts")
    blocks = block_count(keys.count(), dictionary.size, counts.count(), settings)
    cells = _cells(counts, blocks, work)
    start = _note_blocks(spark, keys.count(), blocks, settings, work)
    words = _word_blocks(dictionary, blocks, settings.dim, work)
    trained, words = _passes(cells, start, words, blocks, settings, work, frozen=False)
    return ParagraphVectors(dictionary, words, blocks, settings), _named(trained, keys, blocks, settings.dim)


@dataclass(frozen=True)
class ParagraphFeatures:
    """Fitted features: a tokenizer (a projection) and trained words, from which any note gets its vector."""

    tokenizer: PipelineModel
    model: ParagraphVectors

    @property
    def width(self) -> int:
        return self.model.settings.dim

    def transform(self, notes: DataFrame, key: str) -> DataFrame:
        """Add ``features``."""
        vectors = self.model.infer(self.tokenizer.transform(notes).select(key, "tokens"), key)
        joined = notes.join(vectors.withColumnRenamed("vec", "_vec"), F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
        return joined.withColumn(FEATURES, array_to_vector(F.col("_vec").cast("array<double>"))).drop("_vec")

    def save(self, path: str) -> dict:
        self.tokenizer.write().overwrite().save(f"{path}/tokenizer")
        return {"kind": "paragraphs", **self.model.save(path)}

    @classmethod
    def load(cls, spark: SparkSession, path: str, meta: dict) -> ParagraphFeatures:
        return cls(PipelineModel.load(f"{path}/tokenizer"), ParagraphVectors.load(spark, path, meta))


@dataclass(frozen=True)
class ParagraphFeaturiser:
    """Fits :class:`ParagraphFeatures`: ``stages`` add ``tokens``."""

    stages: list
    settings: Settings
    key: str
    vocab_size: int | None = None

    def fit(self, notes: DataFrame) -> ParagraphFeatures:
        tokenizer = Pipeline(stages=self.stages).fit(notes)
        model, _ = fit(tokenizer.transform(notes).select(self.key, "tokens"), self.key, self.settings, self.vocab_size)
        return ParagraphFeatures(tokenizer, model)

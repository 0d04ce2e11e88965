"""Text features whose dictionary is a table.

Words get their numbers by rank over range partitions, term weights come from a join of
term counts with the dictionary, and one aggregate by note puts them together. No word
list passes through the driver; a dictionary is broadcast only where it was measured and
found small. One row per note: ``key`` names a note.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteforge.functions.text import bound
from noteforge.operators.joins import lookup_join
from noteforge.operators.ranking import top_ranked
from noteforge.runtime import dealt_by, stage_table

FEATURES, TERMS = "features", "terms"
TERM_TYPE = "array<struct<id:int,w:double>>"
WEIGHTINGS = ("freq", "tfidf")
MAX_WIDTH = (1 << 31) - 1  # the largest vector


@dataclass(frozen=True)
class Dictionary:
    """``terms`` is ``(word, id, n, df)``: ids from 0 by falling ``n``, occurrences, notes holding the word."""

    terms: DataFrame
    size: int
    notes: int

    def save(self, path: str) -> None:
        self.terms.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, size: int, notes: int) -> Dictionary:
        return cls(spark.read.parquet(path), size, notes)


def word_counts(notes: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``(word, n, df)``: the first place of a word in its note's sorted tokens counts the note. Texts don't move."""
    def marked(ordered: Column) -> Column:
        return F.transform(ordered, lambda w, i: F.struct(w.alias("word"), (~F.get(ordered, i - 1).eqNullSafe(w)).cast("bigint").alias("new")))

    # the sort is bound: written into the inner function, it would run again for every token;
    # sort_array compares natively, array_sort calls an interpreted comparator for every comparison
    rows = notes.select(F.explode_outer(bound(F.sort_array(tokens), marked)).alias("x")).select("x.word", "x.new").where(F.col("word").isNotNull())
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("new").alias("df"))


def fit_dictionary(notes: DataFrame, tokens: str = "tokens", vocab_size: int | None = None) -> Dictionary:
    """All words of the notes, or the ``vocab_size`` most frequent ones; equal counts by the alphabet."""
    ranked = top_ranked(word_counts(notes, tokens), [F.desc("n"), F.asc("word")], vocab_size, "_rank")
    terms = stage_table(ranked.select("word", (F.col("_rank") - 1).cast("int").alias("id"), "n", "df"), "dictionary")
    size = terms.count()
    if size > MAX_WIDTH:
        raise ValueError(f"{size} words; a vector has {MAX_WIDTH} places at most: set vocab_size or use hashed features")
    return Dictionary(terms, size, notes.count())


def note_terms(notes: DataFrame, key: str, dictionary: Dictionary, weighting: str, tokens: str = "tokens") -> DataFrame:
    """``(_key, terms)`` of every note, ``terms`` by id: counts, or tf-idf weights of unit length. Unknown words are left out."""
    words = dealt_by(notes.select(F.col(key).alias("_key"), tokens), "_key").select("_key", F.explode_outer(tokens).alias("word"))
    counts = words.groupBy("_key", "word").agg(F.count(F.lit(1)).alias("_n"))
    known = dictionary.terms.select("word", "id", "df")
    met = lookup_join(counts, known, "word", "left", spread_by=["_key", "word"], staged=True)
    if weighting == "tfidf":
        weight = (F.log("_n") + 1.0) * (F.log((F.lit(float(dictionary.notes)) + 1.0) / (F.col("df") + 1.0)) + 1.0)
    else:
        weight = F.col("_n").cast("double")
    item = F.when(F.col("id").isNotNull(), F.struct("id", weight.alias("w")))  # nulls aren't collected
    terms = met.groupBy("_key").agg(F.sort_array(F.collect_list(item)).cast(TERM_TYPE).alias(TERMS))
    return terms.withColumn(TERMS, unit_length(F.col(TERMS))) if weighting == "tfidf" else terms


def unit_length(terms: Column) -> Column:
    norm = lambda ts: F.sqrt(F.aggregate(ts, F.lit(0.0), lambda s, t: s + t["w"] * t["w"]))
    divided = lambda ts, n: F.transform(ts, lambda t: F.struct(t["id"].alias("id"), (t["w"] / n).alias("w")))
    # both are bound: written into the inner function, the sum would run again for every term
    return bound(terms, lambda ts: bound(norm(ts), lambda n: divided(ts, n)))


def sparse_vector(terms: Column, size: int) -> Column:
    """Terms as a vector of the given width."""

    @F.pandas_udf(VectorUDT())
    def assemble(ids: pd.Series, values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"type": 0, "size": size, "indices": ids, "values": values}).astype({"type": "int8", "size": "int32"})

    return assemble(F.transform(terms, lambda t: t["id"]), F.transform(terms, lambda t: t["w"]))


@dataclass(frozen=True)
class TableFeatures:
    """Fitted features: a tokenizer (a projection) and a dictionary."""

    tokenizer: PipelineModel
    dictionary: Dictionary
    weighting: str

    @property
    def width(self) -> int:
        return self.dictionary.size

    def transform(self, notes: DataFrame, key: str) -> DataFrame:
        """Add ``terms`` and ``features``. What isn't read later isn't computed."""
        tokens = self.tokenizer.transform(notes).select(key, "tokens")
        found = note_terms(tokens, key, self.dictionary, self.weighting)
        # a null key names one note, as any other
        joined = notes.join(found, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
        terms = F.coalesce(TERMS, F.array().cast(TERM_TYPE))
        return joined.withColumn(TERMS, terms).withColumn(FEATURES, sparse_vector(F.col(TERMS), self.width))

    def save(self, path: str) -> dict:
        """Tables and tokenizer; what :meth:`load` needs besides is returned."""
        self.tokenizer.write().overwrite().save(f"{path}/tokenizer")
        self.dictionary.save(f"{path}/dictionary")
        return {"kind": "terms", "weighting": self.weighting, "size": self.dictionary.size, "notes": self.dictionary.notes}

    @classmethod
    def load(cls, spark: SparkSession, path: str, meta: dict) -> TableFeatures:
        terms = Dictionary.load(spark, f"{path}/dictionary", meta["size"], meta["notes"])
        return cls(PipelineModel.load(f"{path}/tokenizer"), terms, meta["weighting"])


@dataclass(frozen=True)
class TableFeaturiser:
    """Fits :class:`TableFeatures`: ``stages`` add ``tokens``. ``select`` may cut the dictionary down by the labels."""

    stages: list
    weighting: str
    vocab_size: int | None = None
    select: Callable[[DataFrame, Dictionary], Dictionary] | None = None

    def fit(self, notes: DataFrame) -> TableFeatures:
        tokenizer = Pipeline(stages=self.stages).fit(notes)
        tokens = tokenizer.transform(notes)
        dictionary = fit_dictionary(tokens, vocab_size=self.vocab_size)
        return TableFeatures(tokenizer, self.select(tokens, dictionary) if self.select else dictionary, self.weighting)


def term_rows(notes: DataFrame, key: str) -> DataFrame:
    """``(_key, id, w)`` of all terms."""
    return notes.select(F.col(key).alias("_key"), F.inline(TERMS))


def named(rows: DataFrame, dictionary: Dictionary, spread_by: list[str]) -> DataFrame:
    """Add ``word`` to rows with an ``id``."""
    return lookup_join(rows, dictionary.terms.select("id", "word"), "id", spread_by=spread_by, staged=True)

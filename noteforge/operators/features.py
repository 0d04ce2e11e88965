"""Weighted terms, word and note vectors, attention pools, term selection."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteforge import fixed
from noteforge.functions.arrays import dot, literal_array
from noteforge.operators.joins import lookup_join
from noteforge.operators.ranking import top_ranked
from noteforge.operators.tokens import token_rows


def idf(n_notes: Column, df: Column) -> Column:
    """Smoothed inverse document frequency, plus one."""
    return F.log((n_notes + 1.0) / (df + 1.0)) + 1.0


def tfidf(counts: DataFrame, key: str, frequencies: DataFrame, n_notes: int) -> DataFrame:
    """``(key, word, weight)``: ``(1 + ln tf) * idf``, unit length per note.

    ``counts`` is ``(key, word, n)``; ``frequencies`` and ``n_notes`` describe
    the corpus the weights refer to (the training set, for new notes).
    """
    weighted = lookup_join(counts, frequencies, "word", spread_by=[key, "word"])
    weighted = weighted.withColumn("w", (F.log("n") + 1.0) * idf(F.lit(float(n_notes)), F.col("df")))
    # one pass over the note: its terms and its norm together, still hashed by key
    packed = weighted.groupBy(key).agg(
        F.collect_list(F.struct("word", "w")).alias("terms"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")
    )
    return packed.select(key, "norm", F.inline("terms")).select(key, "word", (F.col("w") / F.col("norm")).alias("weight"))


def vocab_vectors(vocab: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """Every dictionary word with its vector; zeros and ``known = 0`` where there is none."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
    joined = vocab.join(vectors.select("word", "vec"), "word", "left")
    return joined.withColumn("known", F.col("vec").isNotNull().cast("bigint")).withColumn(
        "vec", F.coalesce(F.col("vec"), zeros)
    )


def vector_coverage(with_vectors: DataFrame) -> DataFrame:
    return with_vectors.agg(
        F.count(F.lit(1)).alias("words"), F.sum("known").alias("known"), F.avg("known").alias("coverage")
    )


def _pooled(rows: DataFrame, key: str, dim: int, epsilon: float) -> DataFrame:
    """Weighted mean of ``vec`` by ``a``: one aggregate with a sum per dimension."""
    sums = [F.sum(F.col("a") * F.col("vec")[i]).alias(f"_s{i}") for i in range(dim)]
    total = F.col("_a") + epsilon
    return (
        rows.groupBy(key)
        .agg(F.sum("a").alias("_a"), *sums)
        .select(key, F.array(*[F.col(f"_s{i}") / total for i in range(dim)]).alias("vec"))
    )


def pooled_vectors(counts: DataFrame, key: str, vectors: DataFrame, dim: int) -> DataFrame:
    """Mean word vector per note; the weight of a word is its count."""
    rows = lookup_join(counts, vectors, "word", spread_by=[key, "word"])
    return _pooled(rows.withColumn("a", F.col("n").cast("double")), key, dim, 0.0)


def weighted_vectors(weights: DataFrame, key: str, vectors: DataFrame, dim: int) -> DataFrame:
    """Mean word vector per note, weighted by ``weight`` (for example tf-idf)."""
    rows = lookup_join(weights, vectors, "word", spread_by=[key, "word"])
    return _pooled(rows.withColumn("a", F.col("weight")), key, dim, 0.0)


def attention_score(vec: Column, w: Sequence[float], b: float) -> Column:
    """``exp(tanh(x . w + b))``."""
    return F.exp(F.tanh(dot(vec, literal_array(w)) + F.lit(float(b))))


def context_score(vec: Column, matrix: Sequence[Sequence[float]], b: Sequence[float], u: Sequence[float]) -> Column:
    """``exp(sum_j tanh((x W)_j + b_j) u_j)``; ``matrix`` has one row per input dimension."""
    total = F.lit(0.0)
    for j, u_j in enumerate(u):
        column = [row[j] for row in matrix]
        total = total + F.tanh(dot(vec, literal_array(column)) + F.lit(float(b[j]))) * F.lit(float(u_j))
    return F.exp(total)


def _scored_words(vectors: DataFrame, score: Column) -> DataFrame:
    """A word's score depends on its vector only, so it is computed once per word."""
    return vectors.select("word", "vec", score.alias("score"))


def attention_pool(counts: DataFrame, key: str, vectors: DataFrame, score: Column, dim: int,
                   epsilon: float = fixed.EPSILON) -> DataFrame:
    """``(key, vec)``: word vectors weighted by their normalised attention.

    Words without a vector are masked (the inner join drops them). Equal
    words share a score, so ``counts`` is all the pool needs.
    """
    words = _scored_words(vectors, score)
    rows = lookup_join(counts, words, "word", spread_by=[key, "word"])
    return _pooled(rows.withColumn("a", F.col("n") * F.col("score")), key, dim, epsilon)


def attention_weights(notes: DataFrame, key: str, vectors: DataFrame, score: Column,
                      tokens: str = "tokens", epsilon: float = fixed.EPSILON) -> DataFrame:
    """``(key, pos, word, weight)`` per token; weights of a note sum to one."""
    words = _scored_words(vectors, score).select("word", "score")
    rows = lookup_join(token_rows(notes, key, tokens), words, "word", spread_by=[key, "pos"])
    packed = rows.groupBy(key).agg(
        F.collect_list(F.struct("pos", "word", "score")).alias("t"), F.sum("score").alias("total")
    )
    return packed.select(key, "total", F.inline("t")).select(
        key, "pos", "word", (F.col("score") / (F.col("total") + epsilon)).alias("weight")
    )


def top_tokens(notes: DataFrame, key: str, vectors: DataFrame, score: Column, k: int = 20,
               tokens: str = "tokens", epsilon: float = fixed.EPSILON) -> DataFrame:
    """The ``k`` tokens of each note with the largest attention, ties by position.

    The sort happens inside the note's own array.
    """
    words = _scored_words(vectors, score).select("word", "score")
    rows = lookup_join(token_rows(notes, key, tokens), words, "word", spread_by=[key, "pos"])
    packed = rows.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "pos", "word"))).alias("t"),
        F.sum("score").alias("total"),
    )
    return packed.select(key, "total", F.posexplode(F.slice("t", 1, k)).alias("i", "x")).select(
        key,
        (F.col("i") + 1).cast("bigint").alias("place"),
        F.col("x.pos").alias("pos"),
        F.col("x.word").alias("word"),
        (-F.col("x.neg") / (F.col("total") + epsilon)).alias("weight"),
    )


def matrix_rows(df: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    """A vector table in long form: ``(key, dim, value)``, dimensions from 1."""
    return df.select(key, F.posexplode(vec).alias("_d", "value")).select(
        key, (F.col("_d") + 1).cast("bigint").alias("dim"), F.col("value").cast("double").alias("value")
    )


def matrix_wide(df: DataFrame, key: str, dim: int, vec: str = "vec") -> DataFrame:
    """A vector table with columns ``dimension1 .. dimensionN``."""
    return df.select(key, *[F.col(vec)[i].cast("double").alias(f"dimension{i + 1}") for i in range(dim)])


def chi2_terms(counts: DataFrame, label: str, classes: list, class_rows: dict, word: str = "word", n: str = "n") -> DataFrame:
    """``(word, chi2)``: term mass per class against the class shares.

    ``counts`` has one row per (note, term) with its label; ``class_rows``
    gives the notes per class. One aggregate, one column per class.
    """
    total = float(sum(class_rows.values()))
    table = counts.groupBy(word).agg(
        F.sum(n).alias("_all"),
        *[F.sum(F.when(F.col(label) == c, F.col(n)).otherwise(0)).alias(f"_c{i}") for i, c in enumerate(classes)],
    )
    stat = F.lit(0.0)
    for i, c in enumerate(classes):
        expected = F.col("_all") * F.lit(class_rows[c] / total)
        stat = stat + (F.col(f"_c{i}") - expected) * (F.col(f"_c{i}") - expected) / expected
    return table.select(word, stat.alias("chi2"))


def chi2_p_value(stat: Column, dof: int) -> Column:
    """Upper tail of the chi-square distribution for a whole number of degrees of freedom."""
    if dof < 1:
        raise ValueError("needs at least two classes")

    @F.pandas_udf("double")
    def tail(x: pd.Series) -> pd.Series:
        import math

        import numpy as np

        half = x.to_numpy(dtype=float) / 2.0
        if dof % 2 == 0:
            term, total, start = np.ones_like(half), np.ones_like(half), 1.0
            steps = dof // 2 - 1
            scale = np.exp(-half)
            for i in range(steps):
                term = term * half / (start + i)
                total = total + term
            return pd.Series(scale * total)
        out = np.array([math.erfc(math.sqrt(v)) for v in half])
        term = np.exp(-half) * np.sqrt(half) / math.gamma(1.5)
        for i in range((dof - 1) // 2):
            out = out + term
            term = term * half / (1.5 + i)
        return pd.Series(out)

    return tail(stat)


def select_fdr(terms: DataFrame, p_value: str = "p_value", alpha: float = 0.05) -> DataFrame:
    """Terms kept at false discovery rate ``alpha`` (Benjamini-Hochberg step-up)."""
    m = terms.count()
    ranked = top_ranked(terms, [F.asc(p_value), F.asc(terms.columns[0])], None, "_rank")
    bound = ranked.where(F.col(p_value) <= F.col("_rank") * F.lit(alpha / max(m, 1))).agg(F.max(p_value)).first()[0]
    kept = ranked.where(F.lit(False)) if bound is None else ranked.where(F.col(p_value) <= F.lit(bound))
    return kept.drop("_rank")

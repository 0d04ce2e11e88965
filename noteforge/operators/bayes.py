"""Multinomial naive Bayes in closed form, on long-form term counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteforge.operators.joins import lookup_join
from noteforge.operators.tokens import term_counts
from noteforge.runtime import stage

LENGTH = "\0length"  # the pseudo-class that sums the known words of a note


def nb_scores(train: DataFrame, test: DataFrame, key: str, label: str, smoothing: float = 1.0,
              tokens: str = "tokens") -> DataFrame:
    """``(key, class, score)``: log prior plus log likelihood of the known words.

    A word's likelihood is split into ``ln(count + s)`` and the class total.
    Words unseen in a class add ``ln(s)`` there, so only the (word, class)
    pairs that occur are joined; nothing is multiplied out over the vocabulary.
    """
    totals = (
        train.select(label, F.size(tokens).alias("_n"))
        .groupBy(label)
        .agg(F.count(F.lit(1)).alias("notes"), F.sum("_n").alias("tokens"))
        .collect()
    )  # one row per class: the model's parameters
    base = F.lit(float(smoothing))
    lift = F.log((F.col("n") + base) / base)
    # per word: one entry per class it occurs in, and one that counts the word itself
    by_word = stage(
        train.select(F.col(label).alias("class"), F.explode_outer(tokens).alias("word"))
        .where(F.col("word").isNotNull())
        .groupBy("word", "class")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("word")
        .agg(F.collect_list(F.struct("class", lift.alias("lift"))).alias("lifts"))
        .withColumn("lifts", F.concat("lifts", F.array(F.struct(F.lit(LENGTH).alias("class"), F.lit(1.0).alias("lift")))))
    )
    size = by_word.count()
    all_notes = sum(r["notes"] for r in totals)

    counts = term_counts(test, key, tokens).withColumnRenamed("n", "tf")
    hits = lookup_join(counts, by_word, "word", spread_by=[key, "word"], staged=True)
    sums = (
        hits.select(key, "tf", F.inline("lifts"))
        .groupBy(key, "class")
        .agg(F.sum(F.col("tf") * F.col("lift")).alias("lifted"))
        .groupBy(key)
        .agg(F.map_from_entries(F.collect_list(F.struct("class", "lifted"))).alias("sums"))
    )
    classes = F.array(*[
        F.struct(
            F.lit(r[label]).alias("class"),
            F.log(F.lit(r["notes"] / all_notes)).alias("prior"),
            F.log(base / F.lit(r["tokens"] + smoothing * size)).alias("floor"),
        )
        for r in sorted(totals, key=lambda r: r[label])
    ])
    grid = test.select(key).join(sums, key, "left").select(key, "sums", F.inline(classes))

    def of(name) -> Column:
        return F.coalesce(F.col("sums")[name], F.lit(0.0))

    return grid.select(
        key, "class", (F.col("prior") + of(F.lit(LENGTH)) * F.col("floor") + of(F.col("class"))).alias("score")
    )


def nb_predict(scores: DataFrame, key: str) -> DataFrame:
    """The best class per note; equal scores go to the first class."""
    best = F.min(F.struct((-F.col("score")).alias("neg"), F.col("class").alias("class")))
    return scores.groupBy(key).agg(best.alias("b")).select(
        key, F.col("b.class").alias("pred"), (-F.col("b.neg")).alias("score")
    )



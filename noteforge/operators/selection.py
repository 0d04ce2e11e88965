"""Terms chosen on the training notes, and boosting of single terms; both on terms as tables."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteforge.functions.arrays import normalise
from noteforge.functions.text import bound
from noteforge.operators.dictionary import TERMS, Dictionary
from noteforge.operators.features import chi2_p_value, chi2_terms, select_fdr
from noteforge.runtime import Workspace, stage, stage_table

ROUNDS, CUT_EVERY = 100, 10
DIGITS = 12  # of errors that are compared


# --- selection by chi-square ------------------------------------------------------


def chi2_dictionary(notes: DataFrame, label: str, dictionary: Dictionary, alpha: float = 0.05, tokens: str = "tokens") -> Dictionary:
    """The dictionary's words that differ between classes, at a false discovery rate of ``alpha``; ids stay in order.

    A semi join of the dictionary with the kept words; with fewer than two classes all stay.
    """
    sizes = {r[label]: r["n"] for r in notes.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a class
    if len(sizes) < 2:
        return dictionary
    classes = sorted(sizes)
    words = notes.where(F.col(label).isNotNull()).select(label, F.explode(tokens).alias("word"))
    counts = words.join(dictionary.terms.select("word"), "word", "left_semi").groupBy("word", label).agg(F.count(F.lit(1)).alias("n"))
    stats = chi2_terms(counts, label, classes, sizes)
    kept = select_fdr(stage(stats.withColumn("p_value", chi2_p_value(F.col("chi2"), len(classes) - 1))), alpha=alpha)
    return renumbered(dictionary, kept.select("word"))


def renumbered(dictionary: Dictionary, kept: DataFrame) -> Dictionary:
    """The dictionary of the words in ``kept``, with ids from 0."""
    from noteforge.operators.ranking import global_rank

    terms = global_rank(dictionary.terms.join(kept, "word", "left_semi").withColumnRenamed("id", "_old"), ["_old"], "_new")
    terms = stage_table(terms.select("word", (F.col("_new") - 1).cast("int").alias("id"), "n", "df"), "dictionary")
    return Dictionary(terms, terms.count(), dictionary.notes)


# --- boosting ---------------------------------------------------------------------


@dataclass(frozen=True)
class Stump:
    """Notes with the term are of one class, the others of another; ``vote`` is its weight."""

    id: int
    present: int
    absent: int
    vote: float

    def says(self, ids: Column) -> Column:
        return F.when(F.array_contains(ids, self.id), F.lit(self.present)).otherwise(F.lit(self.absent))


def _best(rows: DataFrame, weight: Column, label: str, classes: int) -> tuple[float, float, int | None, int, int]:
    """``(error, total, id, present, absent)`` of the term that errs least; ties go to the smaller id.

    Every term's weighted class sums come from one pass over the postings; what a class weighs
    without the term is the rest of its total.
    """
    weighed = rows.select(F.col(label).alias("_y"), weight.alias("_w"), "ids")
    totals = [0.0] * classes
    for y, w in weighed.groupBy("_y").agg(F.sum("_w")).collect():  # a row a class
        totals[int(y)] = w
    total = sum(totals)
    sums = weighed.select("_y", "_w", F.explode("ids").alias("id")).groupBy("id").agg(
        *[F.sum(F.when(F.col("_y") == c, F.col("_w")).otherwise(0.0)).alias(f"_p{c}") for c in range(classes)]
    )
    with_term = F.array(*[F.round(F.col(f"_p{c}"), DIGITS) for c in range(classes)])
    without = F.array(*[F.round(F.lit(totals[c]) - F.col(f"_p{c}"), DIGITS) for c in range(classes)])
    sums = sums.select("id", with_term.alias("a"), without.alias("b"))
    error = F.round(F.lit(total) - F.array_max("a") - F.array_max("b"), DIGITS)
    place = lambda c: F.array_position(c, F.array_max(c)) - 1  # noqa: E731  the first of equal classes
    first = sums.select(error.alias("e"), "id", place("a").alias("x"), place("b").alias("y")).agg(F.min(F.struct("e", "id", "x", "y")).alias("m")).first()["m"]
    if first is None:
        return total, total, None, 0, 0
    return float(first["e"]), total, int(first["id"]), int(first["x"]), int(first["y"])


def boost_terms(df: DataFrame, label: str, classes: int, rounds: int = ROUNDS, cut_every: int = CUT_EVERY) -> list[Stump]:
    """Multiclass boosting (SAMME) of single terms over the notes' ``terms``.

    In a round only the notes' weights change, and these follow from the stumps so far, inside
    the row; every ``cut_every`` rounds they are written out. Stops when no term is better than
    chance, or one makes no error.
    """
    work = Workspace(df.sparkSession, "boost")
    rows = work.put(df.select(label, F.transform(TERMS, lambda t: t["id"]).alias("ids"), F.lit(1.0).alias("_w")), "notes")
    n = rows.count()
    if not n:
        raise ValueError("nothing to fit on")
    weight: Column = F.col("_w") / F.lit(float(n))
    rows = work.put(rows.withColumn("_w", weight), "notes")
    weight, stumps = F.col("_w"), []
    for r in range(rounds):
        wrong, total, term, present, absent = _best(rows, weight, label, classes)
        error = wrong / total
        if term is None or error >= 1 - 1 / classes - 1e-9:
            break
        vote = math.log((1 - error) / max(error, 1e-10)) + math.log(max(classes - 1, 1))
        stump = Stump(term, present, absent, vote)
        stumps.append(stump)
        if error <= 1e-10:
            break
        miss = (stump.says(F.col("ids")) != F.col(label).cast("int")).cast("double")
        weight = weight * F.exp(miss * vote) / F.lit(total * ((1 - error) + error * math.exp(vote)))
        if (r + 1) % cut_every == 0 and r + 1 < rounds:
            rows, weight = work.put(rows.withColumn("_w", weight), "notes"), F.col("_w")
    work.remove("notes")
    if not stumps:
        raise ValueError("no term is better than chance")
    return stumps


def votes(stumps: list[Stump], classes: int) -> Column:
    """Class shares of a note's votes, from its ``terms``."""
    ids = F.transform(TERMS, lambda t: t["id"])
    rows = F.array(*[F.struct(stump.says(ids).alias("c"), F.lit(stump.vote).alias("v")) for stump in stumps])

    def shares(said: Column) -> Column:
        share = lambda c: F.aggregate(said, F.lit(0.0), lambda s, x: s + F.when(x["c"] == c, x["v"]).otherwise(0.0))
        return normalise(F.array(*[share(c) for c in range(classes)]))

    return bound(rows, shares)

"""Train/test splits and folds, reproducible from the note key alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteforge.operators.joins import null_safe_join
from noteforge.operators.ranking import HASH_DIGITS, hash_key, hash_rank
from noteforge.runtime import stage

MAX_STRATA = 100_000


def stratified_folds(df: DataFrame, key: str, label: str, k: int, reps: int = 1) -> DataFrame:
    """Every row once per repeat with its ``fold`` in 0..k-1; strata differ by at most one row.

    Rows without a label are a stratum of their own, and rows of one key and label
    share their folds. Only (key, label) is repeated and ranked; the rows get their folds in
    one join and are repeated where they lie.
    """
    numbers = F.array(*[F.lit(r).cast("bigint") for r in range(1, reps + 1)])
    narrow = df.select(key, label).distinct().withColumn("rep", F.explode(numbers))
    ranked = hash_rank(narrow, ["rep", label], [key], ["rep"])
    fold = F.struct("rep", ((F.col("rank") - 1) % k).alias("fold"))
    folds = ranked.groupBy(key, label).agg(F.collect_list(fold).alias("_folds"))
    marked = null_safe_join(df, folds, [key, label])
    return marked.withColumn("_f", F.explode("_folds")).select(*df.columns, "_f.rep", "_f.fold")


def _first_share(df: DataFrame, key: str, fraction: float, strata: Sequence[str], seed: str) -> DataFrame:
    """Mark the first ``round(fraction * n)`` rows of each stratum in hash order.

    Only (key, strata) is read to find, per stratum, the hash at which the
    count is reached. The wide rows are then marked by comparing hashes: they
    are not shuffled.
    """
    narrow = df.select(key, *strata, hash_key(key, F.lit(seed)).alias("_h")).withColumn(
        "_b", F.substring("_h", 1, HASH_DIGITS)
    )
    upto = Window.partitionBy(*strata).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = narrow.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_n"))
    located = (
        counts.withColumn("_upto", F.sum("_n").over(upto))
        .withColumn("_all", F.sum("_n").over(Window.partitionBy(*strata)))
        .withColumn("_want", F.round(F.col("_all") * F.lit(fraction)).cast("bigint"))
        .where((F.col("_upto") >= F.col("_want")) & (F.col("_upto") - F.col("_n") < F.col("_want")))
        .withColumn("_need", F.col("_want") - F.col("_upto") + F.col("_n"))
        .select(*strata, "_b", "_need")
    )
    on = [*strata, "_b"]
    inside = Window.partitionBy(*on).orderBy("_h", key)
    cuts = stage(
        null_safe_join(narrow, located, on)
        .withColumn("_rn", F.row_number().over(inside))
        .where(F.col("_rn") == F.col("_need"))
        .select(*strata, F.col("_h").alias("_cut_h"), F.col(key).alias("_cut_key"))
    )
    marked = df.withColumn("_h", hash_key(key, F.lit(seed)))

    def at_most(cut_h: Column, cut_key: Column) -> Column:
        return (F.col("_h") < cut_h) | ((F.col("_h") == cut_h) & (F.col(key) <= cut_key))

    if not strata:
        cut = cuts.first()
        taken = at_most(F.lit(cut["_cut_h"]), F.lit(cut["_cut_key"])) if cut else F.lit(False)
        return marked.withColumn("in_train", taken).drop("_h")
    # one row per stratum
    side = F.broadcast(cuts) if cuts.count() <= MAX_STRATA else cuts
    return (
        null_safe_join(marked, side, list(strata), "left")
        .withColumn("in_train", F.coalesce(at_most(F.col("_cut_h"), F.col("_cut_key")), F.lit(False)))
        .drop("_h", "_cut_h", "_cut_key")
    )


def stratified_split(df: DataFrame, key: str, label: str, fraction: float = 0.7, seed: str = "42") -> DataFrame:
    """Each label gives exactly its rounded share to the training side."""
    return _first_share(df, key, fraction, [label], seed)


def exact_split(df: DataFrame, key: str, fraction: float = 0.7, seed: str = "42") -> DataFrame:
    """Exactly ``round(fraction * n)`` training rows over the whole table."""
    return _first_share(df, key, fraction, [], seed)


def complement(df: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is not in ``taken``."""
    return df.join(taken.select(key), key, "left_anti")


def hash_split(df: DataFrame, key: str, fraction: float = 0.7, seed: str = "42") -> DataFrame:
    """A stable split by hash range; a pure projection, sizes are approximate."""
    return df.withColumn("in_train", hash_share(key, seed) < fraction)


def hash_share(key: str, seed: str) -> Column:
    """The key's place in [0, 1), from the first eight hex digits of its hash."""
    return F.conv(F.substring(hash_key(key, F.lit(seed)), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))

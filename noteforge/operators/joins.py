"""Joins that keep their shape when the data grows or a key is hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteforge.runtime import stage, stage_table

# A side is broadcast only when it was counted and found below both bounds.
BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 128 * 1024 * 1024
FREQUENT_KEYS = 500_000  # that a join with a larger table broadcasts


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure a staged side with one distributed aggregate."""

    def width(field) -> Column:
        kind = field.dataType.simpleString()
        if kind == "string":
            return F.coalesce(F.octet_length(field.name), F.lit(0)) + 16
        if kind.startswith(("array", "struct", "map")):
            return F.coalesce(F.octet_length(F.to_json(F.struct(field.name))), F.lit(0)) + 32
        return F.lit(8)

    row_bytes = sum((width(f) for f in df.schema.fields), F.lit(0))
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(row_bytes), F.lit(0))).first()
    return rows <= max_rows and size <= max_bytes


def heavy_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """Keys holding more than ``share`` of the rows: never more than ``1/share`` of them."""
    counts = stage(df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    return counts.where(F.col("_n") > F.lit(total * share)).select(key, F.lit(True).alias("_hot"))


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null key matches a null key. Key columns come from the left."""
    other = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    matched = F.lit(True)
    for c in on:
        matched = matched & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(other, matched, how).drop(*[f"_r_{c}" for c in on])


def salted_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "inner",
    salts: int = 64,
    share: float = 0.001,
    spread_by: Sequence[str] | None = None,
) -> DataFrame:
    """Shuffle join in which the hot keys of ``left`` are spread over ``salts`` tasks.

    The rows of ``right`` under a hot key are repeated once per salt. The salt
    comes from ``spread_by`` (columns that tell rows apart), so a retried task
    sends each row to the same place. ``how`` is ``inner`` or ``left``.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how!r}")
    hot = F.broadcast(heavy_keys(left, key, share))  # at most 1/share rows
    salt = F.pmod(F.xxhash64(*(spread_by or left.columns)), F.lit(salts)).cast("int")
    left = (
        left.join(hot, key, "left")
        # a null key matches nothing, but all its rows would lie in one task
        .withColumn("_salt", F.when(F.col("_hot") | F.col(key).isNull(), salt).otherwise(0))
        .drop("_hot")
    )
    right = (
        right.join(hot, key, "left")
        .withColumn("_salt", F.explode(
            F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
        ))
        .drop("_hot")
    )
    return left.join(right, [key, "_salt"], how).drop("_salt")


def lookup_join(
    left: DataFrame,
    table: DataFrame,
    key: str,
    how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
    spread_by: Sequence[str] | None = None,
    staged: bool = False,
) -> DataFrame:
    """Join a long frame to a derived table.

    The table is computed once, measured, and broadcast when it is small;
    otherwise the table's rows of the keys that are frequent in ``left`` are
    (:func:`parted_join`).
    """
    table = table if staged else stage(table)
    if is_small(table, max_rows):
        return left.join(F.broadcast(table), key, how)
    return parted_join(left, table, key, how, spread_by=spread_by)


def parted_join(
    left: DataFrame, table: DataFrame, key: str, how: str = "inner", keys: int = FREQUENT_KEYS, spread_by: Sequence[str] | None = None,
) -> DataFrame:
    """Join in which the rows of frequent keys stay where they are; those of the others, which are few, are shuffled.

    ``left`` is computed once. At most ``keys`` keys are broadcast, each with more than a ``keys``-th of
    the rows, so no key that is shuffled is hot. Where the table has too many rows of them, and for
    other joins than ``inner`` and ``left``, it is a salted join.
    """
    if how not in ("inner", "left"):
        return salted_join(left, table, key, how, spread_by=spread_by)
    left = stage_table(left, "lookup")
    frequent = stage(heavy_keys(left, key, 1.0 / keys).where(F.col(key).isNotNull()).select(key))
    common = stage(table.join(F.broadcast(frequent), key, "left_semi"))
    if not is_small(common):
        return salted_join(left, table, key, how, spread_by=spread_by)
    if how == "inner":
        near = left.join(F.broadcast(common), key)
    else:  # null keys match nothing and stay as well
        marked = left.join(F.broadcast(frequent.withColumn("_frequent", F.lit(True))), key, "left")
        near = marked.where(F.col("_frequent") | F.col(key).isNull()).drop("_frequent").join(F.broadcast(common), key, "left")
    far = left.where(F.col(key).isNotNull()).join(F.broadcast(frequent), key, "left_anti")
    return near.unionByName(far.join(table.join(F.broadcast(frequent), key, "left_anti"), key, how))


def notes_with_labels(notes: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Attach labels by key. Both sides have one row per note, so no key is hot."""
    return notes.join(labels, key, "inner")


def match_counts(notes: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """How many keys match, and how many stand alone on either side."""
    sides = (
        notes.select(key, F.lit(1).alias("_n"), F.lit(0).alias("_l"))
        .unionByName(labels.select(key, F.lit(0).alias("_n"), F.lit(1).alias("_l")))
        .groupBy(key)
        .agg(F.max("_n").alias("_n"), F.max("_l").alias("_l"))
    )
    return sides.agg(
        F.sum(F.col("_n") * F.col("_l")).alias("matched"),
        F.sum(F.col("_n") * (1 - F.col("_l"))).alias("notes_only"),
        F.sum(F.col("_l") * (1 - F.col("_n"))).alias("labels_only"),
    )

"""Exact ranks and running totals without putting a group into one task.

A group is cut into ordered buckets. Bucket totals are small and give each
bucket its offset; the window then runs inside (group, bucket) only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteforge.operators.joins import null_safe_join
from noteforge.runtime import stage

HASH_DIGITS = 4  # 65,536 buckets per group


def hash_key(*parts: Column | str) -> Column:
    """A reproducible shuffle order: md5 over the parts joined by ``|``."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def running_in_buckets(
    df: DataFrame,
    group: Sequence[str],
    bucket: str,
    order: Sequence[Column | str],
    sums: dict[str, Column],
) -> DataFrame:
    """Add inclusive running totals per group; ``bucket`` must rise with ``order``."""
    names = list(sums)
    df = df.withColumns({f"_x_{n}": sums[n] for n in names})
    totals = df.groupBy(*group, bucket).agg(*[F.sum(f"_x_{n}").alias(f"_t_{n}") for n in names])
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *group, bucket, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in names]
    )
    inside = (
        Window.partitionBy(*group, bucket)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = null_safe_join(df, offsets, [*group, bucket])
    out = out.withColumns({n: F.col(f"_o_{n}") + F.sum(f"_x_{n}").over(inside) for n in names})
    return out.drop(*[f"_{p}_{n}" for n in names for p in "xo"])


def hash_rank(df: DataFrame, group: Sequence[str], key: Sequence[str], salt: Sequence[Column | str]) -> DataFrame:
    """Add ``rank``: position within the group in the order of a salted hash of the key.

    The hash is uniform, so the first digits of it are even buckets whatever
    the size of the group.
    """
    df = df.withColumn("_h", hash_key(*key, *salt)).withColumn("_b", F.substring("_h", 1, HASH_DIGITS))
    out = running_in_buckets(df, group, "_b", ["_h", *key], {"rank": F.lit(1).cast("bigint")})
    return out.drop("_h", "_b")


def _range_staged(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Range-partition by ``order`` and fix the layout, so partitions are ordered buckets."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return stage(
        ranged.withColumn("_part", F.spark_partition_id()).withColumn(
            "_pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        )
    )


def global_rank(df: DataFrame, order: Sequence[Column | str], out: str = "rank") -> DataFrame:
    """Dense positions 1..n in the order of ``order``; no single-task window over rows."""
    parts = _range_staged(df, order)
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    # one row per partition: bounded by the number of shuffle partitions
    return (
        parts.join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_off") + F.col("_pos") + 1)
        .drop("_part", "_pos", "_off")
    )


def running_totals(
    df: DataFrame, group: Sequence[str], order: Sequence[str], sums: dict[str, Column]
) -> DataFrame:
    """Inclusive running totals per group over any order."""
    parts = _range_staged(df, [*group, *order]).drop("_pos")
    return running_in_buckets(parts, group, "_part", list(order), sums).drop("_part")


SINGLE_TASK_ROWS = 1_000


def top_ranked(df: DataFrame, order: Sequence[Column], limit: int | None, out: str = "rank") -> DataFrame:
    """The first ``limit`` rows with their positions.

    Up to ``SINGLE_TASK_ROWS`` kept rows are ranked in one task after a
    distributed top-k; larger results are ranked by range partition.
    """
    if limit is not None and limit <= SINGLE_TASK_ROWS:
        top = df.orderBy(*order).limit(limit)
        return top.withColumn(out, F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    ranked = global_rank(df, order, out)
    return ranked if limit is None else ranked.where(F.col(out) <= limit)

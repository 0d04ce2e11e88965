"""Array functions: fixed-length id sequences and small vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pad_right(ids: Column | str, size: int = 300) -> Column:
    """Crop at the end, fill with zeros at the end."""
    zero = F.lit(0).cast("bigint")
    return F.slice(F.concat(_col(ids), F.array_repeat(zero, size)), 1, size)


def pad_left(ids: Column | str, size: int) -> Column:
    """Crop at the start, fill with zeros at the start."""
    zero = F.lit(0).cast("bigint")
    return F.slice(F.concat(F.array_repeat(zero, size), _col(ids)), -size, size)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def argmax(values: Column | str) -> Column:
    """Zero-based position of the (first) largest value."""
    values = _col(values)
    return (F.array_position(values, F.array_max(values)) - 1).cast("bigint")


def normalise(values: Column | str) -> Column:
    """Divide by the sum; equal shares when the sum is zero."""
    values = _col(values)
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    return F.transform(values, lambda x: F.when(total > 0, x / total).otherwise(F.lit(1.0) / F.size(values)))


def literal_array(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])

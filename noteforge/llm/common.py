"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII letters only: the contracts lower-case A-Z and leave all else alone.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column | str) -> Column:
    return F.translate(text, UPPER, LOWER)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table, spread over the session's cores when it comes in fewer splits."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores // 2 else df


def bucket_of(doc_id: Column | str, mod: int) -> Column:
    """``crc32`` of the id as text, modulo ``mod``; a null id counts as an empty text."""
    key = (F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")
    return F.pmod(F.crc32(F.coalesce(key, F.lit("")).cast("binary")), F.lit(mod))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


ARROW_TYPES = {
    "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(),
    "binary": pa.binary(),
}


def arrow_schema(ddl: str) -> pa.Schema:
    """Schema of plain columns, also where no session is, as in a task."""
    return pa.schema([(name, ARROW_TYPES[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def table_of(columns: dict[str, object], schema: str) -> pa.Table:
    """A table of lists or arrays by name."""
    target = arrow_schema(schema)
    return pa.Table.from_arrays([pa.array(columns[f.name], f.type) for f in target], schema=target)


def map_arrow(
    df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterable[dict[str, object]]], schema: str
) -> DataFrame:
    """``mapInArrow`` for functions that yield plain columns (lists or arrays by name)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in rows(batches):
            yield from table_of(columns, schema).to_batches()

    return df.mapInArrow(run, schema)


def chunks_of(total: int, size: int) -> Iterator[slice]:
    for at in range(0, total, size):
        yield slice(at, at + size)

"""Score notes as they arrive."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from noteforge.operators.models import Bundle
from noteforge.plans.jobs import scored_columns


def note_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet",
                files_per_batch: int = 1000) -> DataFrame:
    """New parquet files of a folder; the schema is given, so a restart cannot change it."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("pathGlobFilter", pattern)
        .parquet(folder)
    )


def score_stream(notes: DataFrame, bundle: Bundle, key: str, out: str, checkpoint: str,
                 once: bool = True, partition_by: Iterable[str] = ()) -> StreamingQuery:
    """Write scored notes to ``out``, a folder ``batch=<number>`` for each batch.

    A batch joins its terms with the model's tables, as in a batch job. Scoring keeps no state,
    so progress is the file log alone; a batch that is repeated after a failure replaces its folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        writer = scored_columns(bundle, batch, key).write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(f"{out}/batch={number}")

    writer = notes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()


def scored_notes(spark: SparkSession, out: str) -> DataFrame:
    """All that a stream has written, without the number of the batch."""
    return spark.read.parquet(out).drop("batch")

"""A training corpus from raw documents: identify, clean, deduplicate, decontaminate, pack.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each
result as Parquet and reads it again as the next stage's ``docs``. All stages but the last
return the columns of ``docs``, work on every row they get, and are deterministic.

Nulls and empty texts: the first stage rejects them, as they have no language. A text of
which line removal leaves nothing stays as an empty one, which is nobody's duplicate and
holds no benchmark item. An empty table passes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteforge.llm.common import free_name, read_table
from noteforge.llm.langid import UNKNOWN, identify, train
from noteforge.llm.leaks import find_leaks
from noteforge.llm.lines import remove_repeated_lines
from noteforge.llm.neardup import near_duplicates
from noteforge.llm.packing import pack
from noteforge.runtime import stage_table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the languages that the labelled ones teach.

    A text in another script or of random letters shares too few n-grams with any of them.
    """
    model, own = train(docs), free_name(docs, "_language")
    found = docs.withColumn(own, identify(docs, model))
    known = (F.col(f"{own}.lang_pred") != UNKNOWN) & (F.col(f"{own}.known") >= model.floor)
    return found.where(known).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of several lines that an earlier document has."""
    cleaned = remove_repeated_lines(docs).select(*docs.columns)
    return cleaned.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in docs.columns else cleaned


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near-duplicates."""
    classes = near_duplicates(docs)
    later = classes.where(~F.col("doc_id").eqNullSafe(F.col("class_id"))).select("doc_id").distinct()
    return docs.join(later, "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word of a benchmark passage."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = find_leaks(docs, benchmark, out="_leak")
    return found.where(F.col("_leak.n_hit") == 0).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens, neighbours together."""
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("packing", packing),
]

#: A learned classifier, alignment classes and token ids are beyond SQL; tests hold ``run`` against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

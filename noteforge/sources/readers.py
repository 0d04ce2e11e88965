"""Readers: notes tables, note folders, annotation XML, concept lines, word vectors."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteforge import fixed
from noteforge.operators.concepts import CONCEPT_TYPE

CAS_SCHEMA = (
    f"`{fixed.CAS_TEXT}` struct<_sofaString:string>, "
    f"`{fixed.CAS_CONCEPT}` array<struct<_cui:string,_tui:string,_code:string,_codingScheme:string>>"
)


def table(spark: SparkSession, folder: str, name: str, key: str | None = None) -> DataFrame:
    """A parquet table.

    With ``key``, an input that has fewer splits than the session has cores is
    spread by key; a table of many splits is left as it lies.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if key and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores, key)
    return df


def read_notes(spark: SparkSession, path: str, schema: str = fixed.NOTES_DDL) -> DataFrame:
    """Tab-separated notes with a header, as :func:`noteforge.sources.writers.write_tsv` writes them."""
    # an absent field reads as the null mark, which no escaped text can be; a quoted empty one as empty
    rows = spark.read.csv(
        path, sep="\t", header=True, schema=schema, quote='"', escape='"', nullValue=fixed.TSV_NULL, emptyValue=""
    )
    return rows.select(*[
        unescaped(F.col(f.name)).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name)
        for f in rows.schema.fields
    ])


def unescaped(value: Column) -> Column:
    """Undo the sink's escapes; an escaped backslash is set aside first."""
    (slash, slash_escaped), *breaks = fixed.TSV_ESCAPES
    parts = F.split(value, re.escape(slash_escaped), -1)

    def broken(part: Column) -> Column:
        for plain, escaped in breaks:
            part = F.replace(part, F.lit(escaped), F.lit(plain))
        return part

    return F.array_join(F.transform(parts, broken), slash)


def read_named(spark: SparkSession, path: str, schema: str = fixed.COHORT_DDL) -> DataFrame:
    """A headerless tab-separated table with the given names and types."""
    return spark.read.csv(path, sep="\t", header=False, schema=schema, dateFormat="yyyy-MM-dd")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """``fname`` and ``label``, keyed; labels are never attached by position."""
    return read_named(spark, path, "fname string, label string")


def read_latin1(spark: SparkSession, path: str, schema: str, text: int = 1) -> DataFrame:
    """A Latin-1 table with a header; the text is the column at position ``text``."""
    df = spark.read.csv(path, sep="\t", header=True, schema=schema, encoding="ISO-8859-1", quote='"', escape='"')
    return df.select(df.columns[0], F.col(df.columns[text]).alias("text"))


def read_text_folder(spark: SparkSession, folder: str, suffix: str = ".txt") -> DataFrame:
    """One row per file: ``(fname, text)``."""
    files = spark.read.option("pathGlobFilter", f"*{suffix}").text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_name").alias("fname"), F.col("value").alias("text"))


def cas_columns(text, concepts) -> list:
    """Typed columns from the parts of a parsed annotation document."""
    named = F.transform(
        concepts,
        lambda c: F.struct(
            c["_cui"].alias("cui"), c["_tui"].alias("tui"), c["_code"].alias("code"), c["_codingScheme"].alias("scheme")
        ),
    )
    return [text.alias("text"), F.coalesce(named, F.array().cast(CONCEPT_TYPE)).alias("concepts")]


def read_annotation_xml(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file: ``(fname, text, concepts)``; zero or one concept is an array too."""
    files = (
        spark.read.format("xml").schema(CAS_SCHEMA).option("rowTag", fixed.CAS_ROOT)
        .option("pathGlobFilter", "*.xml").load(folder)
    )
    return files.select(
        F.col("_metadata.file_name").alias("fname"),
        *cas_columns(F.col(f"`{fixed.CAS_TEXT}`._sofaString"), F.col(f"`{fixed.CAS_CONCEPT}`")),
    )


def parse_annotation_xml(df: DataFrame, xml: str) -> DataFrame:
    """Replace the column ``xml`` by ``text`` and ``concepts``."""
    parsed = df.withColumn("_cas", F.from_xml(F.col(xml), CAS_SCHEMA, {"rowTag": fixed.CAS_ROOT}))
    rest = [c for c in df.columns if c != xml]
    return parsed.select(
        *rest, *cas_columns(F.col(f"_cas.`{fixed.CAS_TEXT}`._sofaString"), F.col(f"_cas.`{fixed.CAS_CONCEPT}`"))
    )


def to_annotation_xml(df: DataFrame, text: str = "text", concepts: str = "concepts", out: str = "xml") -> DataFrame:
    """Replace ``text`` and ``concepts`` by one XML document."""
    items = F.transform(
        F.col(concepts),
        lambda c: F.struct(
            c["cui"].alias("_cui"), c["tui"].alias("_tui"), c["code"].alias("_code"), c["scheme"].alias("_codingScheme")
        ),
    )
    doc = F.struct(
        F.struct(F.col(text).alias("_sofaString")).alias(fixed.CAS_TEXT), items.alias(fixed.CAS_CONCEPT)
    )
    rest = [c for c in df.columns if c not in (text, concepts)]
    return df.select(*rest, F.to_xml(doc, {"rowTag": fixed.CAS_ROOT}).alias(out))


def read_concept_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Pipe-delimited concept lines: ``(fname, line, score, name, cui, semtypes)``."""
    lines = spark.read.text(folder).select(F.col("_metadata.file_name").alias("fname"), F.col("value").alias("line"))
    parts = F.split("line", r"\|")
    return lines.where(F.col("line").startswith(fixed.CONCEPT_LINE_PREFIX)).select(
        "fname", "line",
        F.get(parts, F.lit(2)).try_cast("double").alias("score"),
        F.get(parts, F.lit(3)).alias("name"),
        F.get(parts, F.lit(4)).alias("cui"),
        F.split(F.regexp_replace(F.get(parts, F.lit(5)), r"[\[\]]", ""), ",").alias("semtypes"),
    )


def read_word_vectors(spark: SparkSession, path: str, dim: int | None = None) -> DataFrame:
    """``word v1 .. vn`` lines as ``(word, vec)``; a ``count dim`` header line is skipped."""
    parts = F.split(F.trim("value"), " ")
    rows = spark.read.text(path).where(F.size(parts) > 2)
    out = rows.select(parts[0].alias("word"), F.slice(parts, F.lit(2), F.size(parts) - 1).cast("array<float>").alias("vec"))
    return out if dim is None else out.where(F.size("vec") == dim)

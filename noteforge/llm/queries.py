"""The registered queries of this package and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteforge.llm import sql
from noteforge.llm.common import bucket_of, read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_suffix_repeats(spark: SparkSession, sf: str) -> DataFrame:
    from noteforge.llm.repeats import remove_repeats

    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    return remove_repeats(docs, keep="none", with_text=False)


def op2_curve_packing(spark: SparkSession, sf: str) -> DataFrame:
    from noteforge.llm.packing import pack

    return pack(read_table(spark, sf, "documents").select("doc_id", "text"))


def op3_line_chunks(spark: SparkSession, sf: str) -> DataFrame:
    from noteforge.llm.lines import remove_repeated_lines

    return remove_repeated_lines(read_table(spark, sf, "documents").select("doc_id", "text"))


def op4_language_id(spark: SparkSession, sf: str) -> DataFrame:
    from noteforge.llm.langid import train, with_language

    docs = read_table(spark, sf, "documents").select("doc_id", "text", "lang")
    held_out = bucket_of("doc_id", 5) == 0
    model = train(docs.where(~held_out))
    return with_language(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_order_minhash(spark: SparkSession, sf: str) -> DataFrame:
    from noteforge.llm.neardup import near_duplicates

    return near_duplicates(read_table(spark, sf, "documents").select("doc_id", "text"))


def op6_benchmark_leaks(spark: SparkSession, sf: str) -> DataFrame:
    from noteforge.llm.leaks import leak_report

    return leak_report(read_table(spark, sf, "documents"), spark.read.parquet(f"{sf}/benchmark.parquet")).drop("spans")


def op7_deleted_interpolation(spark: SparkSession, sf: str) -> DataFrame:
    from noteforge.llm.ngram import score_documents

    return score_documents(read_table(spark, sf, "documents").select("doc_id", "text"))


def op8_top_k(spark: SparkSession, sf: str) -> DataFrame:
    from noteforge.llm.topk import EVERY, integer_vectors, top_k

    vectors = integer_vectors(read_table(spark, sf, "embeddings"), "vec_id", "embedding")
    # of rows that repeat a query id, the smallest vector asks
    asked = vectors.where(F.pmod("id", F.lit(EVERY)) == 0).groupBy("id").agg(F.min("v").alias("v"))
    return top_k(vectors, asked)


def op9_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    from noteforge.llm.urls import judge_urls

    pages = read_table(spark, sf, "pages").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def op10_warc(spark: SparkSession, sf: str) -> DataFrame:
    from noteforge.llm.warc import intact, round_trip

    return intact(round_trip(read_table(spark, sf, "pages"))).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op11_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    from noteforge.llm.toxicity import train, with_toxicity

    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    held_out = bucket_of("doc_id", 4) == 2
    model = train(docs.where(~held_out), spark.read.parquet(f"{sf}/labels.parquet"))
    return with_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op12_target_resample(spark: SparkSession, sf: str) -> DataFrame:
    from noteforge.llm.resample import resample

    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    drawn = resample(docs, spark.read.parquet(f"{sf}/benchmark.parquet").select("text"))
    return drawn.withColumnRenamed("id", "doc_id")


def op13_cover_tree_codes(spark: SparkSession, sf: str) -> DataFrame:
    from noteforge.llm.codes import books_digest, vector_codes, with_label_errors

    coded, books = vector_codes(read_table(spark, sf, "embeddings").select("vec_id", "embedding", "label"))
    out = with_label_errors(coded).withColumn("codebooks_sha256", F.lit(books_digest(books)))
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (op1_suffix_repeats, op2_curve_packing, op3_line_chunks, op4_language_id, op5_order_minhash, op6_benchmark_leaks, op7_deleted_interpolation, op8_top_k, op9_url_filter, op10_warc, op11_toxicity, op12_target_resample, op13_cover_tree_codes)
}
SQL: dict[str, str] = {
    "op3_line_chunks": sql.LINES,
    "op6_benchmark_leaks": sql.LEAKS,
    "op8_top_k": sql.TOP_K,
    "op9_url_filter": sql.URLS,
    "op10_warc": sql.WARC,
    "op12_target_resample": sql.RESAMPLE,
    "op13_cover_tree_codes": sql.CODES,
}

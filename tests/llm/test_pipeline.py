"""Stages against brute force on a small table."""

import corpus_pipeline as pipeline
from noteforge.llm import leaks
from tests.llm.fixtures import DOCS, awkward, documents
from tests.llm.test_leaks import brute as brute_leaks
from tests.llm.test_neardup import classes


FAR = 1_000_000  # ids that the table doesn't have
ROWS = [(i if i is None else FAR + i, t) for i, t in awkward()]


def test_order_of_stages():
    assert [name for name, _ in pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]


def test_every_stage_on_its_own_input(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(documents(spark, ROWS))
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    stages = dict(pipeline.STAGES)

    known = stages["language_id"](spark, docs, sf).cache()
    assert known.columns == docs.columns
    kept = {r["doc_id"] for r in known.collect()}
    assert {r["doc_id"] for r in docs.collect() if r["lang"] is not None} <= kept  # real text stays
    assert not kept & {FAR + i for i in (13, 14, 15, 16)}

    cleaned = stages["line_dedup"](spark, known, sf).cache()
    assert cleaned.columns == docs.columns and cleaned.count() == known.count()
    assert all(r["n_chars"] == len(r["text"]) for r in cleaned.collect())

    rows = [(r["doc_id"], r["text"]) for r in cleaned.collect()]
    root = classes(rows)
    single = stages["near_dedup"](spark, cleaned, sf).cache()
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in single.collect()))) == sorted(repr(r) for r in rows if root[r[0]] == r[0])

    clean = stages["decontamination"](spark, single, sf).cache()
    want = [r["doc_id"] for r in single.collect() if not brute_leaks(r["text"], items, leaks.WIDTH)[1]]
    assert clean.columns == docs.columns and sorted(map(repr, want)) == sorted(repr(r["doc_id"]) for r in clean.collect())

    pieces = stages["packing"](spark, clean, sf)
    assert {r["doc_id"] for r in pieces.collect()} == set(want)


def test_run(spark, sf):
    assert pipeline.run(spark, sf).count() > 0


def test_empty_table(spark, sf):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, sf).collect() == []

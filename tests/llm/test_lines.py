"""Line chunks: defined results of awkward rows, and shift resistance."""

import random

from pyspark.sql import functions as F

from noteforge.llm.lines import remove_repeated_lines
from tests.llm.fixtures import DOCS, awkward, documents, words


def test_passage_goes_from_later_documents_wherever_it_stands(spark):
    rng = random.Random(3)
    passage = [" ".join(words(rng, 10)) for _ in range(60)]
    own = [[" ".join(words(rng, 8)) for _ in range(n)] for n in (3, 5, 11)]
    rows = [(1, "\n".join(own[0] + passage)), (2, "\n".join(own[1] + passage + own[2])), (3, "\n".join(own[2]))]
    got = {r["doc_id"]: r for r in remove_repeated_lines(documents(spark, rows)).collect()}
    assert got[1]["text"] == rows[0][1] and got[1]["n_removed"] == 0
    left = got[2]["text"].split("\n")
    assert got[2]["n_removed"] >= 30 and set(own[1][:4]) <= set(left)
    assert [x for x in left if x not in passage] == own[1] + [x for x in own[2] if x in left]


def test_awkward_rows_and_clashing_columns(spark):
    docs = documents(spark, awkward()).withColumn("n_lines", F.lit(7))
    got = remove_repeated_lines(docs).collect()
    assert len(got) == len(awkward())
    assert got[0].asDict().keys() == {*docs.columns, "n_lines_", "n_removed"}
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[13][0]["text"] is None and by[13][0]["n_lines_"] == 0
    assert by[14][0]["text"] == "" and by[14][0]["n_lines_"] == 1
    assert all(r["n_lines"] == 7 for r in got)
    for i, text in awkward():  # one line: nothing to remove
        if text is not None and "\n" not in text:
            assert text in [r["text"] for r in by[i]]


def test_repeats_within_a_document_keep_the_first(spark):
    block = "\n".join(f"line {i}" for i in range(40))
    got = remove_repeated_lines(documents(spark, [(5, block + "\n" + block), (None, block)])).collect()
    by = {r["doc_id"]: r for r in got}
    assert by[None]["n_removed"] == 0  # a null id comes first
    assert by[5]["n_lines"] == 80 and by[5]["n_removed"] >= 60


def test_empty_table(spark):
    assert remove_repeated_lines(spark.createDataFrame([], DOCS)).collect() == []


def test_no_python_in_the_plan(spark):
    plan = remove_repeated_lines(documents(spark, [(1, "a\nb")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan

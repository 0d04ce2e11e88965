"""Every registered query against its SQL, and the shape of the plans."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from tools.check import compare, connect  # noqa: E402


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, sf, con, name):
    result = compare(entry.queries()[name](spark, sf), con, entry.oracle_sql()[name])
    assert result.startswith("ok"), result


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["lang", "word", "weight", "place"] and df.count() > 0


BUILT_IN = ["clean_note", "deid_text", "html_text", "tokens", "sentence_rows", "term_counts", "tfidf", "kfold",
            "doc_concepts", "token_ids", "attention_pool", "metrics", "stem_counts", "label_onehot"]


@pytest.mark.parametrize("name", BUILT_IN)
def test_plans_stay_in_the_jvm_without_cross_joins(spark, sf, name):
    plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert node not in plan


def test_projection_needs_no_shuffle_and_reads_two_columns(spark, sf):
    plan = entry.queries()["scan_labels"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    plan = entry.queries()["label_counts"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<lang:string>" in plan

"""Benchmark passages against brute force, in one automaton and in several."""

import hashlib
import re

import pytest

from noteforge.llm.leaks import find_leaks, leak_report
from tests.llm.fixtures import DOCS, awkward, documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id bigint, text string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(text, items, width=10):
    w = WORD.findall(lower(text))
    hit, found = set(), set()
    for item_id, t in items:
        x = WORD.findall(lower(t))
        n = min(width, len(x))
        wins = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if x else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                if item_id is not None:
                    found.add(item_id)
    ids = ",".join(sorted(map(str, found)))
    return len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


def test_awkward_rows(spark):
    rows = awkward()
    base = rows[0][1].split()
    items = [(1, " ".join(base[5:30]).upper()), (2, "..." + ", ".join(base[20:30])), (3, "short"), (4, None), (5, "?!"),
             (None, " ".join(base[50:62])), (6, "東京"), (7, " ".join(base[5:14]) + " nothing"), (1, "x y")]
    docs, bench = documents(spark, rows), spark.createDataFrame(items, ITEMS)
    got = leak_report(docs, bench).drop("spans").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((i, *brute(t, items)) for i, t in rows), key=repr)
    several = find_leaks(docs.withColumnRenamed("source", "leak"), bench, max_bytes=120)
    one = find_leaks(docs, bench)
    key = lambda r: repr((r["doc_id"], r["text"], r["leak"]))
    assert sorted(map(key, several.collect())) == sorted(map(key, one.collect()))


def test_offsets_are_of_the_original(spark):
    text = "Before — IT was,  the BEST\tof times; it was the worst of times! After"
    bench = spark.createDataFrame([(1, "it was the best of times it was the worst of times")], ITEMS)
    leak = find_leaks(documents(spark, [(1, text)]), bench).first()["leak"]
    assert [text[s["start"] : s["stop"]] for s in leak["spans"]] == ["IT was,  the BEST\tof times; it was the worst of times"]


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_empty_sides(spark, rows):
    bench = spark.createDataFrame(rows, ITEMS)
    assert [r["contaminated"] for r in leak_report(documents(spark, [(1, "a b c")]), bench).collect()] == [False]
    assert leak_report(spark.createDataFrame([], DOCS), bench).collect() == []

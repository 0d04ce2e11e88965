"""Repeated byte strings against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from noteforge.llm.repeats import names, remove_repeats, sliding_least
from tests.llm.fixtures import DOCS, awkward, documents


def brute(rows, width, keep):
    rows = sorted(((i, (t or "").encode()) for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    seen, first = Counter(), {}
    for n, (_, t) in enumerate(rows):
        for p in range(len(t) - width + 1):
            s = t[p : p + width]
            seen[s] += 1
            first.setdefault(s, (n, p))
    out = []
    for n, (i, t) in enumerate(rows):
        gone = bytearray(len(t))
        for p in range(len(t) - width + 1):
            s = t[p : p + width]
            if seen[s] > 1 and (keep == "none" or first[s] != (n, p)):
                gone[p : p + width] = b"\1" * width
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        out.append((i, len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize("keep,hot,block_bytes", [("none", 20_000, 24 << 20), ("none", 1, 2000), ("first", 1, 2000)])
def test_awkward_rows(spark, keep, hot, block_bytes):
    # for "first", which of two different rows of one id comes first is left open: give each its own
    rows = awkward() if keep == "none" else [(i if i is not None else None, t) for i, t in awkward() if i is not None and (i, t) != (2, "other text of the same id")]
    got = remove_repeats(documents(spark, rows), keep=keep, hot=hot, block_bytes=block_bytes).collect()
    assert sorted((tuple(r)[:5] + (bytes(r["kept"]),) for r in got), key=repr) == brute(rows, 200, keep)


def test_small_width_and_shared_tables(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = remove_repeats(documents(spark, rows), width=40, gram=16, keep="first").collect()
    assert sorted((tuple(r)[:5] + (bytes(r["kept"]),) for r in got), key=repr) == brute(rows, 40, "first")


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], DOCS)).collect() == []


def test_names_and_least():
    data = np.frombuffer(b"abcabcabcabcab" * 9, np.uint8)
    grams, full = names(data, 13, 5)
    text = data.tobytes()
    for hashes, size in ((grams, 5), (full, 13)):
        assert len(hashes) == len(text) - size + 1
        by = {}
        for i, h in enumerate(hashes.tolist()):
            assert by.setdefault(text[i : i + size], h) == h
        assert len(set(by.values())) == len(by)
    keys = np.random.default_rng(1).integers(0, 99, 57).astype(np.uint64)
    assert sliding_least(keys, 9).tolist() == [int(keys[i : i + 9].min()) for i in range(49)]

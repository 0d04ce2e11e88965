"""Interpolated scores against a plain model in dictionaries."""

import math
from collections import Counter

import numpy as np

from noteforge.llm import blocks as B
from noteforge.llm import ngram as N
from tests.llm.fixtures import DOCS, awkward, documents


def tokens(text):
    lowered = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    return lowered.split() + ["end"]


def test_counts_and_base_score(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()] + awkward()
    got = N.score_documents(documents(spark, rows), block_bytes=50_000).collect()
    assert len(got) == len(rows)
    count = Counter(w for i, t in rows if not N.is_test(i) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    want = sorted(
        (repr(i), N.is_test(i), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n,
         round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(t)), 6))
        for i, t in rows
    )
    assert sorted((repr(r[0]), *r[1:5], round(r[5], 6)) for r in got) == want
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["score"] < 0 for r in got)


def test_model_scores(spark):
    rows = [(i, " ".join("abcdefgh"[(i * j) % 8] for j in range(1, 30))) for i in range(80)]
    docs = documents(spark, rows)
    got = {r["doc_id"]: r for r in N.score_documents(docs).collect()}
    # the same model, from its definition; which blocks are held out is read from the blocks themselves
    n_blocks = B.block_count(docs)
    held = set()
    for r in B.to_blocks(docs, n_blocks).collect():
        if r["block"] in N.HELD:
            ids, _ = B.documents_of(B.table_of({"block": [r["block"]], "data": [bytes(r["data"])]}, B.BLOCK_TYPE))
            held |= set(ids)
    def counts(ids):
        word, pair = Counter(), Counter()
        for i, t in rows:
            if i in ids:
                x = ["begin", *tokens(t)]
                word.update(x)
                pair.update(zip(x, x[1:]))
        return word, pair
    training = {i for i, _ in rows if not N.is_test(i)}
    kept_word, kept_pair = counts(training - held)
    kept = sum(c for w, c in kept_word.items() if w != "begin")
    kept_words = len(kept_word) - 1
    cell = Counter()
    for i, t in rows:
        if i in training & held:
            x = ["begin", *tokens(t)]
            for u, w in zip(x, x[1:]):
                q = [round(N.CELL * math.log2(a / b)) if a else N.UNSEEN for a, b in ((kept_pair[u, w], max(1, kept_word[u])), (kept_word[w], kept))]
                cell[int(N.bucket(np.array([kept_word[u]]))[0]), *q] += 1
    weights = N.learn([(*k, n) for k, n in cell.items()], kept_words)
    word, pair = counts(training)
    n, v = sum(c for w, c in word.items() if w != "begin"), len(word) - 1
    for i, t in rows:
        x = ["begin", *tokens(t)]
        want = 0.0
        for u, w in zip(x, x[1:]):
            a = weights[int(N.bucket(np.array([word[u]]))[0])]
            want += math.log10(a[0] * pair[u, w] / max(1, word[u]) + a[1] * word[w] / n + a[2] / (v + 1))
        assert abs(got[i]["score"] - want) < 1e-6


def test_probabilities_sum_to_one():
    weights = N.learn([(3, -4, -8, 50), (3, N.UNSEEN, -8, 20), (3, N.UNSEEN, N.UNSEEN, 5), (0, N.UNSEEN, -3, 9)], 6)
    assert np.allclose(weights.sum(axis=1), 1) and weights[0][0] == 0 and (weights[:, 1:] > 0).all()
    model = N.Model(weights, 12, 6)
    word = np.array([4, 3, 2, 1, 1, 1, 0])  # six known words and the unknown one
    pair = np.array([3, 2, 0, 0, 0, 0, 0])
    assert abs((10 ** model.log10(pair, np.full(7, 5), word)).sum() - 1) < 1e-9


def test_no_training_rows_and_empty(spark):
    test_id = next(i for i in range(99) if N.is_test(i))
    got = N.score_documents(documents(spark, [(test_id, "a b")])).collect()
    assert [tuple(r) for r in got] == [(test_id, True, 3, 0, 0, 0.0, 0.0)]
    assert N.score_documents(spark.createDataFrame([], DOCS)).collect() == []


def test_packed_arrays():
    rng = np.random.default_rng(2)
    for a in (np.zeros(0, np.uint64), rng.integers(0, 1 << 62, 1000).astype(np.uint64), np.array([3], np.int32)):
        assert (B.unpack(B.pack(a)) == a).all() and B.unpack(B.pack(a)).dtype == a.dtype
    keys = np.unique(rng.integers(0, 1 << 64, 500, np.uint64))
    assert (B.unpack_sorted(B.pack_sorted(keys)) == keys).all()
    assert (np.diff(B.part_of(keys, 7)) >= 0).all() and B.part_of(keys, 7).max() <= 6

"""Pieces against the tokenizer, and their places in sequences."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from noteforge.llm.packing import ADDED, hilbert_key, pack, tokenizer_path, tokens_of
from tests.llm.fixtures import DOCS, awkward, documents


def reference_ids(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_ids_are_those_of_the_tokenizers_library(spark, sf):
    texts = [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts += [t for _, t in awkward()] + ["a  b\x85c \n\n x", "don't I'LL ²³½ ªº _x_", "<|endoftext|> x", "日本 ١٢ é"]
    tokens = tokens_of(tokenizer_path())
    assert [np.frombuffer(tokens.ids(t or ""), "<u4").tolist() for t in texts] == reference_ids(texts)


def test_pieces_cover_documents_and_fill_sequences(spark):
    rows = awkward()
    got = pack(documents(spark, rows)).collect()
    want = {}
    for (i, _), ids in zip(rows, reference_ids([t for _, t in rows])):
        want.setdefault((i, len(ids) + 1), []).append(ids + [1])
    assert sum(r["length"] for r in got) == sum(len(x) for w in want.values() for x in w)
    for r in got:
        crcs = {zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for x in want[r["doc_id"], r["doc_tokens"]]}
        assert r["ids_crc32"] in crcs
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
    short = [s for s, p in sequences.items() if sum(n for _, n in p) < 2048]
    assert len(short) <= 4  # at most one for each task


def test_added_tokens_in_texts_are_one_id(spark):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {a.content: i for i, a in t.get_added_tokens_decoder().items()} == ADDED
    texts = ["a<|endoftext|>b", "<|endoftext|>", "x  <|endoftext|>\n <|endoftext|><|endoftext|> é", "<|endoftext|", "<<|endoftext|>>"]
    want = [t.encode(x, add_special_tokens=False).ids + [1] for x in texts]
    got = {r["doc_id"]: r for r in pack(documents(spark, list(enumerate(texts)))).collect()}
    for i, ids in enumerate(want):
        assert got[i]["doc_tokens"] == len(ids) and got[i]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_hilbert_neighbours_touch():
    cells = {}
    for x in range(8):
        for y in range(8):
            cells[hilbert_key(np.array([x / 4 - 1 + 0.01, y / 4 - 1 + 0.01]), 3)] = (x, y)
    path = [cells[k] for k in sorted(cells)]
    assert sorted(cells) == list(range(64))
    assert all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in zip(path, path[1:]))


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], DOCS)).collect() == []

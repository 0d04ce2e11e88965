"""Language-model scoring by deleted interpolation.

The model mixes maximum-likelihood estimates of bigrams and single words with a
uniform share for unknown words. The mixture weights depend on how often the context
was seen (a bucket for each power of two). They are learned by expectation-maximisation
on counts of held-out training blocks, against counts from which these blocks are left
out; the final estimates use the counts of all training documents.

Counts are of the whole training part, by :mod:`noteforge.llm.blocks`: no word or pair is
left out, and words and pairs are told apart by 64-bit hashes. For learning the weights,
held-out tokens are added up in cells of equal bucket and of equal log probabilities (a
quarter of an octave wide): a table of bounded size, whatever the corpus.

Defined results: a null or empty text is one end token. Rows that repeat a document
are each scored, and each counted in training. Without training documents all weight
is on the uniform share, of 1. An empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteforge.llm import blocks as B
from noteforge.runtime import stage_table

MOD, TEST = 7, 2
HELD = B.Held(3)
CELL = 4  # cells in an octave
ROUNDS = 40
START = (0.5, 0.4, 0.1)
WORDS, PAIRS = 0, 1
SCORE_TYPE = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
CELL_TYPE = "bucket int, q2 int, q1 int, n bigint"


def is_test(doc_id: int | None) -> bool:
    return crc32(("" if doc_id is None else str(doc_id)).encode()) % MOD == TEST


class Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


#: Holding a blank, these are no words.
BEGIN, END = b" begin", b" end"


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two."""
    with np.errstate(over="ignore"):
        h = a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


class Counted:
    """Tokens, words and pairs of a block."""

    def __init__(self, group: pa.Table):
        self.ids, texts = B.documents_of(group)
        numbers = Numbers()
        begin, end = numbers[BEGIN], numbers[END]
        number, tokens, sizes = numbers.__getitem__, [], []
        for text in texts:
            own = list(map(number, text.lower().split()))  # bytes: A-Z only, and ASCII blanks
            own.append(end)
            tokens.append(np.array(own, np.int32))
            sizes.append(len(own))
        self.sizes = np.array(sizes, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.tokens = np.concatenate([*tokens, np.zeros(0, np.int32)])
        before = np.roll(self.tokens, 1)
        before[self.starts] = begin
        self.before, self.end, self.begin = before, end, begin
        test = np.array([is_test(i) for i in self.ids], bool)
        self.test, self.trains = test, np.repeat(~test, self.sizes)
        hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in numbers], np.uint64)
        pairs = before.astype(np.int64) << 32 | self.tokens
        found, self.pair = np.unique(pairs, return_inverse=True)
        keys = mixed(hashes[found >> 32], hashes[found & 0xFFFFFFFF])
        self.word_order, self.pair_order = np.argsort(hashes), np.argsort(keys)
        self.word_keys, self.pair_keys = hashes[self.word_order], keys[self.pair_order]

    def key_rows(self, block: int, parts: int) -> dict[str, list]:
        words = np.bincount(self.tokens[self.trains], minlength=len(self.word_keys))
        pairs = np.bincount(self.pair[self.trains], minlength=len(self.pair_keys))
        a = B.key_rows(WORDS, block, self.word_keys, words[self.word_order], parts)
        b = B.key_rows(PAIRS, block, self.pair_keys, pairs[self.pair_order], parts)
        return {k: a[k] + b[k] for k in a}

    def sums(self, sent: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token: counts of its pair, of its context and of itself."""
        words, pairs = np.zeros(len(self.word_keys), np.int64), np.zeros(len(self.pair_keys), np.int64)
        words[self.word_order] = B.answers(sent, WORDS, column)
        pairs[self.pair_order] = B.answers(sent, PAIRS, column)
        words[self.begin] = words[self.end]  # a text begins as often as one ends
        return pairs[self.pair], words[self.before], words[self.tokens]


def bucket(count: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, else one for each power of two."""
    return np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))) + 1, 0).astype(np.int64)


UNSEEN = -(1 << 20)


def cells(counted: Counted, sent: pa.Table, n: int) -> dict[str, list]:
    """Held-out training tokens by bucket and rounded log probabilities."""
    use = counted.trains
    pair, context, word = (x[use] for x in counted.sums(sent, "kept"))

    def rounded(a: np.ndarray, b) -> np.ndarray:
        share = np.maximum(a, 1) / np.maximum(b, 1)
        return np.where(a > 0, np.rint(CELL * np.log2(share)), UNSEEN).astype(np.int64)

    rows = np.stack([bucket(context), rounded(pair, context), rounded(word, n)])
    found, count = np.unique(rows, axis=1, return_counts=True)
    return {"bucket": found[0].tolist(), "q2": found[1].tolist(), "q1": found[2].tolist(), "n": count.tolist()}


def learn(table: list[tuple[int, int, int, int]], kept_words: int) -> np.ndarray:
    """Mixture weights (pairs, words, uniform) for each bucket, by expectation-maximisation."""
    weights = np.tile(np.array(START), (64, 1))
    weights[0] = (0, START[1] + START[0], START[2])
    x = np.array(table, np.int64).reshape(-1, 4)
    seen = set(x[:, 0].tolist())
    for b in range(64):
        if b not in seen:
            if b > 1:
                weights[b] = weights[b - 1]
            continue
        _, q2, q1, n = x[x[:, 0] == b].T
        p = np.stack([np.where(q == UNSEEN, 0.0, 2.0 ** (q / CELL)) for q in (q2, q1)] + [np.full(len(n), 1 / (kept_words + 1))])
        w = weights[b]
        for _ in range(ROUNDS):
            share = w[:, None] * p
            share = share / share.sum(axis=0) * n
            w = share.sum(axis=1) / n.sum()
        w = np.maximum(w, (0, 1e-7, 1e-7))
        weights[b] = w / w.sum()
    return weights


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    train_tokens: int
    train_words: int

    def log10(self, pair: np.ndarray, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        w = self.weights[bucket(context)]
        p = w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * word / max(1, self.train_tokens) + w[:, 2] / (self.train_words + 1)
        return np.log10(p)


def scored(counted: Counted, sent: pa.Table, model: Model) -> dict[str, list]:
    pair, context, word = counted.sums(sent, "total")
    n, v = model.train_tokens, model.train_words
    per_doc = [
        np.add.reduceat(x, counted.starts)
        for x in ((word > 0).astype(np.int64), np.log10((word + 1) / (n + v + 1)), model.log10(pair, context, word))
    ]
    return {
        "doc_id": counted.ids, "held_out": counted.test.tolist(), "n_tokens": counted.sizes.tolist(),
        "n_known": per_doc[0].tolist(), "train_tokens": [n] * len(counted.ids),
        "base_score": per_doc[1].tolist(), "score": per_doc[2].tolist(),
    }


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """One row per document: its counts, the base score and the model's score."""
    n_blocks = parts = B.block_count(docs, text, block_bytes)
    blocks = B.to_blocks(docs, n_blocks, doc_id, text)
    keys = B.per_block(blocks, lambda b, group: Counted(group).key_rows(b, parts), B.KEY_TYPE)
    sums = stage_table(B.sum_keys(keys, HELD), "ngram-sums")
    totals = sums.where(F.col("kind") == WORDS).agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n_total", "n_keys", "n_kept", "n_kept_keys")])
    n, v, kept, kept_words = totals.first()
    in_held = F.pmod("block", F.lit(B.LEAST_BLOCKS)) == HELD.remainder
    table = (
        B.with_answers(blocks.where(in_held), sums.where(in_held), lambda b, group, sent: cells(Counted(group), sent, kept), CELL_TYPE)
        .groupBy("bucket", "q2", "q1").agg(F.sum("n").alias("n"))
    )
    weights = learn([tuple(r) for r in table.collect()], kept_words)  # at most a row for each cell
    model = Model(weights if n else np.tile(np.array((0.0, 0.0, 1.0)), (64, 1)), n, v)
    return B.with_answers(blocks, sums, lambda b, group, sent: scored(Counted(group), sent, model), SCORE_TYPE)

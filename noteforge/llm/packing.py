"""Packing along a space-filling curve.

Each document becomes a hashed vector of its byte 4-grams, projected to a few
dimensions; its place on a Hilbert curve through those dimensions is its key.
Documents are range-sorted by key, so that tasks hold stretches of the curve, and
each task tokenises its documents in that order and cuts the stream of ids every
``length`` tokens. A sequence therefore holds neighbours on the curve, and only the
last sequence of a task is padded (not at all, when its length is a power of two).

The key breaks ties by document id and text hash, so copies, which share a key, spread
over tasks when there are many. Ids are those of the ``tokenizers`` library as it loads
the vocabulary, so added tokens (``ADDED``) in a text are one id each; they are made here
by the same merges in their rank form, which is several times faster.

Defined results: a null or empty text is its end id alone, placed first on the
curve. Rows that repeat a document id are packed each on their own. An empty table
gives no pieces. Further columns of the input are not needed and not kept.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteforge.llm.common import map_arrow

LENGTH, END_ID = 2048, 1
ADDED = {"<|endoftext|>": 50256}  # the vocabulary file's added tokens
DIMENSIONS, BITS, BUCKETS = 3, 10, 256
PIECE_TYPE = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
)


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """A public vocabulary file: the same merges as the ``tokenizers`` file, as ranks."""
    import public_tokenizers

    return public_tokenizers.path(name)


# --- ids -----------------------------------------------------------------------


class Tokens:
    """Text -> its ids as little-endian 32-bit bytes."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED)

    def ids(self, text: str) -> bytes:
        """Added tokens are encoded like any text."""
        return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes()

    def ids_with_added(self, text: str) -> bytes:
        if not any(t in text for t in ADDED):
            return self.ids(text)
        return np.array(self.encoding.encode(text, allowed_special="all"), "<u4").tobytes()


_TOKENS: dict[str, Tokens] = {}


def tokens_of(path: str) -> Tokens:
    if path not in _TOKENS:
        _TOKENS[path] = Tokens(path)
    return _TOKENS[path]


# --- the curve -----------------------------------------------------------------


@lru_cache(maxsize=4)
def projection(dimensions: int = DIMENSIONS, buckets: int = BUCKETS) -> np.ndarray:
    return np.random.default_rng(7).choice([-1.0, 1.0], (buckets, dimensions))


def hashed_point(text: bytes, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A point in [-1, 1]: the unit vector of hashed byte 4-grams, projected."""
    a = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(a) < 4:
        a = np.concatenate([a, np.zeros(4 - len(a), np.uint32)])
    grams = a[:-3] | a[1:-2] << 8 | a[2:-1] << 16 | a[3:] << 24
    slots = (grams * np.uint32(0x9E3779B1)) >> np.uint32(24)
    v = np.sqrt(np.bincount(slots, minlength=BUCKETS))
    v -= v.mean()
    norm = np.linalg.norm(v)
    return np.tanh(v @ projection(dimensions) / norm) if norm else np.zeros(dimensions)


def hilbert_key(point: np.ndarray, bits: int = BITS) -> int:
    """Place on the Hilbert curve of a grid cell: axes to the transposed index, then its bits interleaved."""
    n = len(point)
    x = [min((1 << bits) - 1, int((p + 1) / 2 * (1 << bits))) for p in point]
    q = 1 << (bits - 1)
    while q > 1:  # undo the turns from the top level down
        low = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= low
            else:
                swap = (x[0] ^ x[i]) & low
                x[0] ^= swap
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            turn ^= q - 1
        q >>= 1
    key = 0
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | ((x[i] ^ turn) >> b & 1)
    return key


def curve_keys(texts: pa.Array) -> list[int]:
    """0 for null and empty texts, else 1 + the place on the curve."""
    return [1 + hilbert_key(hashed_point(t.encode())) if t else 0 for t in texts.to_pylist()]


# --- packing -------------------------------------------------------------------


@dataclass
class Packer:
    """Cuts a stream of documents every ``length`` ids."""

    first: int
    length: int = LENGTH
    sequence: int = 0
    offset: int = 0
    rows: list[tuple] = field(default_factory=list)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total, start = len(ids) // 4, 0
        while start < total:
            take = min(total - start, self.length - self.offset)
            crc = zlib.crc32(ids[4 * start : 4 * (start + take)])
            self.rows.append((doc_id, start, take, crc, total, self.first + self.sequence, self.offset))
            start += take
            self.offset += take
            if self.offset == self.length:
                self.sequence, self.offset = self.sequence + 1, 0

    def taken(self) -> dict[str, list]:
        rows, self.rows = self.rows, []
        names = [c.split()[0] for c in PIECE_TYPE.split(", ")]
        return dict(zip(names, map(list, zip(*rows)))) if rows else {n: [] for n in names}


def curve_order(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, text, key)`` range-partitioned and sorted along the curve."""
    key = F.arrow_udf("bigint")(lambda t: pa.array(curve_keys(t), pa.int64()))
    placed = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).withColumn("key", key("text"))
    order = ["key", "doc_id", F.xxhash64("text")]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order)


def pack(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = END_ID, path: str | None = None
) -> DataFrame:
    """One row per piece of a document: where it starts in it, and where it stands in its sequence."""
    path = path or tokenizer_path()
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        from pyspark import TaskContext

        # a task holds fewer than 2**32 sequences, so its numbers are its own
        packer, tokens = Packer(TaskContext.get().partitionId() << 32, length), tokens_of(path)
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                packer.add(i, tokens.ids_with_added(t or "") + end)
            yield packer.taken()

    return map_arrow(curve_order(docs, doc_id, text).select("doc_id", "text"), run, PIECE_TYPE)

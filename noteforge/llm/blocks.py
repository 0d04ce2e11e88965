"""Corpus-wide counts of very many keys, by blocks of documents.

A *block* holds the documents of one hash value, about ``BLOCK_BYTES`` of text; it
is small enough for one task at any size of the corpus, as the number of blocks grows
with the text. A block counts its keys (64-bit hashes) once each, sorted, and sends
them, packed, to *parts* of the key range. A part adds up what all blocks have, and
answers each block in the order of its keys, so that keys travel only one way. A key
that is everywhere costs one entry for each block.

Documents travel as compressed Arrow tables. In a block they are sorted by id and
text, so that every task that meets a block again sees the same order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteforge.llm.common import map_arrow, table_of

BLOCK_BYTES = 12 << 20
LEAST_BLOCKS = 8

BLOCK_TYPE = "block bigint, data binary"
KEY_TYPE = "kind int, part bigint, block bigint, keys binary, counts binary"
SUM_TYPE = (
    "kind int, part bigint, block bigint, total binary, kept binary, n_keys bigint, n_total bigint, n_kept_keys bigint, n_kept bigint"
)


def pack(values: np.ndarray) -> bytes:
    """Compressed bytes of an integer array: like bytes of all values together."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T if len(values) else values.view(np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(values.dtype.char.encode() + planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    kind = np.dtype(raw[:1].decode())
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel() if planes.size else np.zeros(0, kind)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def compact(counts: np.ndarray) -> np.ndarray:
    """The same counts in the narrowest type that holds them."""
    top = int(counts.max()) if len(counts) else 0
    return counts.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))


def block_count(docs: DataFrame, text: str = "text", size: int = BLOCK_BYTES) -> int:
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text) + 64), F.lit(0))).first()[0]
    return max(LEAST_BLOCKS, -(-total // size))


def to_blocks(docs: DataFrame, blocks: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(block, data)``: tables of ``doc_id, text``, one for each block and batch read."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            block = batch.column(0).to_numpy(zero_copy_only=False)
            found, data = np.unique(block), []
            own = batch.select([1, 2])
            for b in found:
                part = own.filter(pa.array(block == b))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=options) as writer:
                    writer.write_batch(part)
                data.append(sink.getvalue().to_pybytes())
            yield {"block": found.tolist(), "data": data}

    return map_arrow(rows, run, BLOCK_TYPE)


def documents_of(group: pa.Table) -> tuple[list[int | None], list[bytes]]:
    """Ids and UTF-8 texts of a block in its fixed order; null texts are empty."""
    ids: list[int | None] = []
    texts: list[bytes] = []
    for data in group["data"].to_pylist():
        table = pa.ipc.open_stream(data).read_all()
        ids += table["doc_id"].to_pylist()
        texts += [t or b"" for t in table["text"].cast(pa.binary()).to_pylist()]
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i]))
    return [ids[i] for i in order], [texts[i] for i in order]


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of the key range that each key falls into; it rises with the key. ``parts < 2**32``."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def key_rows(kind: int, block: int, keys: np.ndarray, counts: np.ndarray, parts: int) -> dict[str, list]:
    """Packed rows of sorted, different keys, one for each part that has some."""
    part = part_of(keys, parts)
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    out: dict[str, list] = {"kind": [], "part": [], "block": [], "keys": [], "counts": []}
    for a, b in zip(starts, [*starts[1:], len(keys)]):
        for name, value in zip(out, (kind, int(part[a]), block, pack_sorted(keys[a:b]), pack(compact(counts[a:b])))):
            out[name].append(value)
    return out


@dataclass(frozen=True)
class Held:
    """Blocks whose counts are left out of the ``kept`` sums."""

    remainder: int | None = None

    def __contains__(self, block: int) -> bool:
        return self.remainder is not None and block % LEAST_BLOCKS == self.remainder


def sum_keys(rows: DataFrame, held: Held = Held()) -> DataFrame:
    """Answers to blocks: for each packed row, the sums over all blocks in the order of its keys.

    The first row of each part also has how many keys have a sum, and their sum.
    """

    def run(group: pa.Table) -> pa.Table:
        kinds, parts, blocks = (group[c].to_pylist() for c in ("kind", "part", "block"))
        keys = [unpack_sorted(k) for k in group["keys"].to_pylist()]
        counts = np.concatenate([unpack(c).astype(np.int64) for c in group["counts"].to_pylist()])
        found, place = np.unique(np.concatenate(keys), return_inverse=True)
        use = np.repeat([b not in held for b in blocks], [len(k) for k in keys])
        total = np.bincount(place, counts, len(found)).astype(np.int64)
        kept = np.bincount(place[use], counts[use], len(found)).astype(np.int64)
        out: dict[str, list] = {"kind": kinds, "part": parts, "block": blocks, "total": [], "kept": []}
        at = 0
        for k in keys:
            own = place[at : at + len(k)]
            out["total"].append(pack(compact(total[own])))
            out["kept"].append(pack(compact(kept[own])) if held.remainder is not None else None)
            at += len(k)
        rest = [0] * (len(blocks) - 1)
        out |= {
            "n_keys": [int((total > 0).sum()), *rest], "n_total": [int(total.sum()), *rest],
            "n_kept_keys": [int((kept > 0).sum()), *rest], "n_kept": [int(kept.sum()), *rest],
        }
        return table_of(out, SUM_TYPE)

    return rows.groupBy("kind", "part").applyInArrow(run, SUM_TYPE)


def answers(group: pa.Table, kind: int, column: str) -> np.ndarray:
    """A block's sums of one kind, in the order of its keys."""
    rows = sorted((p, x) for k, p, x in zip(*(group[c].to_pylist() for c in ("kind", "part", column))) if k == kind)
    return np.concatenate([np.zeros(0, np.int64), *[unpack(x).astype(np.int64) for _, x in rows]])


def per_block(blocks: DataFrame, run: Callable[[int, pa.Table], dict[str, list]], schema: str) -> DataFrame:
    def apply(key, group):
        return table_of(run(key[0].as_py(), group), schema)

    return blocks.groupBy("block").applyInArrow(apply, schema)


def with_answers(
    blocks: DataFrame, sums: DataFrame, run: Callable[[int, pa.Table, pa.Table], dict[str, list]], schema: str
) -> DataFrame:
    """Each block beside what was sent to it."""

    def apply(key, group, sent):
        if not group.num_rows:
            return table_of({f.split()[0]: [] for f in schema.split(", ")}, schema)
        return table_of(run(key[0].as_py(), group, sent), schema)

    return blocks.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(apply, schema)

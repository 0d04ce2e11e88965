"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items.

Text is lower-cased (A-Z) and cut into words, as runs of ASCII letters, digits and
all characters beyond ASCII. Every window of ``width`` consecutive words of an item
(an item of fewer words is one window) is a pattern, written as words between
single spaces; a document is scanned once in the same form, and each hit is mapped
back to word numbers and to character offsets of the original text.

Benchmarks are test sets of bounded size: patterns are sent to the tasks in
automata of at most ``MAX_PATTERN_BYTES`` of item text each. A larger benchmark is
cut by item into several such automata, each scanned in turn, and their hits are
united per document, so that none is dropped.

Defined results: null or empty texts have no words and no hits; items without a
word are never hit; an item without an id marks words but is not listed; items
that repeat, or share windows, are all listed. Documents that repeat are each
judged. An empty benchmark marks nothing.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 10
MAX_PATTERN_BYTES = 8 << 20

#: Bytes of words; the others become blanks. A-Z becomes a-z.
WORD_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20
    for c in range(256)
)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

LEAK_TYPE = "struct<n_words:bigint,n_hit:bigint,items:array<bigint>,spans:array<struct<start:int,stop:int>>>"


def words_of(text: str | None) -> list[str]:
    return (text or "").encode("utf-8", "replace").translate(WORD_BYTES).decode("utf-8").split(" ") if text else []


def normalised(text: str | None) -> list[str]:
    """The words of a text, lower-cased."""
    return [w for w in words_of(text) if w]


def windows(words: list[str], width: int) -> Iterator[tuple[str, ...]]:
    if words:
        for i in range(max(1, len(words) - width + 1)):
            yield tuple(words[i : i + width])


def patterns(items: Iterable[tuple[int | None, str | None]], width: int) -> dict[str, tuple[int, tuple[int, ...]]]:
    """Pattern -> (words, ids of the items that hold it)."""
    found: dict[str, tuple[int, set[int]]] = {}
    for item_id, text in items:
        for w in windows(normalised(text), width):
            ids = found.setdefault(" " + " ".join(w) + " ", (len(w), set()))[1]
            if item_id is not None:
                ids.add(item_id)
    return {k: (n, tuple(sorted(ids))) for k, (n, ids) in found.items()}


def build(items: Iterable[tuple[int | None, str | None]], width: int):
    import ahocorasick

    trie = ahocorasick.Automaton()
    for text, (n, ids) in patterns(items, width).items():
        trie.add_word(text, (n, ids))
    if len(trie):
        trie.make_automaton()
    return trie


def scan(text: str | None, trie) -> tuple[int, np.ndarray, set[int]]:
    """(words, a mark per word that is hit, ids of the items with a hit)."""
    words = normalised(text)
    marks = np.zeros(len(words) + 1, np.int32)
    ids: set[int] = set()
    if words and len(trie):
        line = " " + " ".join(words) + " "
        ends = None
        for end, (n, owners) in trie.iter(line):
            if ends is None:  # where each word ends in the line
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            last = int(np.searchsorted(ends, end))
            marks[last - n + 1] += 1
            marks[last + 1] -= 1
            ids.update(owners)
    return len(words), np.cumsum(marks[:-1]) > 0, ids


def spans_of(text: str, hit: np.ndarray) -> list[dict[str, int]]:
    """Character offsets of the runs of hit words."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    at = [m.span() for m in WORD.finditer(text)]
    return [{"start": at[a][0], "stop": at[b - 1][1]} for a, b in zip(edges[::2], edges[1::2])]


_BUILT: dict[tuple[str, int], object] = {}


def _automaton(sent, width: int):
    """The automaton of a part, built once in each worker: ``sent`` is (number, broadcast items)."""
    number, items = sent
    if (number, width) not in _BUILT:
        _BUILT.clear()
        _BUILT[number, width] = build(items.value, width)
    return _BUILT[number, width]


def leak_udf(sent, width: int):
    @F.arrow_udf(LEAK_TYPE)
    def leaks(texts: pa.Array) -> pa.Array:
        trie, out = _automaton(sent, width), []
        for text in texts.to_pylist():
            n, hit, ids = scan(text, trie)
            spans = spans_of(text, hit) if hit.any() else []
            out.append({"n_words": n, "n_hit": int(hit.sum()), "items": sorted(ids), "spans": spans})
        kind = pa.struct([
            ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.int64())),
            ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
        ])
        return pa.array(out, kind)

    return leaks


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
    max_bytes: int = MAX_PATTERN_BYTES,
    out: str = "leak",
) -> DataFrame:
    """Add the struct ``out``: n_words, n_hit, items (sorted ids) and spans. A projection: no shuffle.

    A column named ``out`` is replaced; all others are kept.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("t"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("t") + 64), F.lit(0))).first()[0]
    parts = max(1, -(-size // max_bytes))
    share = F.pmod(F.xxhash64("i", "t"), F.lit(parts))
    found = []
    for part in range(parts):
        sent = spark.sparkContext.broadcast([tuple(r) for r in items.where(share == part).toLocalIterator()])
        found.append(leak_udf((uuid.uuid4().hex, sent), width)(F.col(text)))
    if parts == 1:
        return docs.withColumn(out, found[0])
    several = F.array(*found)
    spans = F.flatten(F.transform(several, lambda x: x["spans"]))
    pieces = docs.withColumn(out, F.struct(
        several[0]["n_words"].alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.transform(several, lambda x: x["items"])))).alias("items"),
        spans.alias("spans"),
    ))
    return pieces.withColumn(out, unite_udf()(F.col(text), F.col(out)))


def unite_udf():
    """Hits of several automata over one text as one set of hits."""

    @F.arrow_udf(LEAK_TYPE)
    def unite(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for text, x in zip(texts.to_pylist(), found.to_pylist()):
            hit = np.zeros(x["n_words"], bool)
            if x["spans"]:
                starts = np.array([m.start() for m in WORD.finditer(text)])
                for s in x["spans"]:
                    hit[(starts >= s["start"]) & (starts < s["stop"])] = True
            spans = spans_of(text, hit) if hit.any() else []
            out.append({"n_words": x["n_words"], "n_hit": int(hit.sum()), "items": x["items"], "spans": spans})
        kind = pa.struct([
            ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.int64())),
            ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
        ])
        return pa.array(out, kind)

    return unite


def leak_report(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document: counts, the digest of the item ids, and whether it is contaminated."""
    found = find_leaks(docs.select(key, "text"), benchmark)
    ids = F.array_sort(F.transform("leak.items", lambda x: x.cast("string")))
    return found.select(
        key,
        F.col("leak.n_words").alias("n_words"),
        F.col("leak.n_hit").alias("n_hit"),
        F.size("leak.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.col("leak.n_hit") > 0).alias("contaminated"),
        F.col("leak.spans").alias("spans"),
    )

"""Dictionary phrases of any length, found by a word trie.

A phrase is words between single blanks. Its prefixes of one, two, ... words are the nodes
of a trie; a node is held as a 64-bit hash of its words, in a sorted array for each depth,
with a flag where a phrase ends. Nodes are made and made distinct by Spark, and put into
parts of ``PART_NODES`` nodes at most by the hash of the first word; a first word that has
more than its share is spread by the hash of the phrase. A part is a broadcast of that size.

The walk takes the token arrays of many notes at once: the places whose first word is a
node of depth one go on to depth two with the next word, and so on. One row leaves for each
hit. A hit's words are then joined with the dictionary as text, so equal hashes of unequal
phrases do no harm.

Defined results: notes with null or empty tokens, and null tokens, have no hits; null or
empty phrases find nothing. Hits may overlap. Rows that repeat a key are searched one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from noteforge.operators.joins import lookup_join
from noteforge.runtime import stage_table

PART_NODES = 4_000_000  # nine bytes each
SLICE_WORDS, REMEMBERED = 200_000, 250_000  # words that are Python objects at a time; words whose hash is kept
NODE_TYPE = "depth int, node bigint, ends boolean"
_GOLD = np.uint64(0x9E3779B97F4A7C15)

Level = tuple[np.ndarray, np.ndarray]  # sorted nodes of one depth, and whether phrases end there


def word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


def next_node(node: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The node reached from ``node`` by a word."""
    with np.errstate(over="ignore"):
        h = (node * _GOLD) ^ word
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def phrase_nodes(phrases: DataFrame) -> DataFrame:
    """``(part_key..., depth, node, ends)`` of the prefixes of every phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, depths, nodes, ends = [], [], [], []
            for part, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = phrase.split(" ")
                node = np.zeros(1, np.uint64)
                for depth, word in enumerate(words):
                    node = next_node(node, np.array([word_hash(word)], np.uint64))
                    parts.append(part)
                    depths.append(depth)
                    nodes.append(int(node.view(np.int64)[0]))
                    ends.append(depth == len(words) - 1)
            columns = [pa.array(parts, pa.int64()), pa.array(depths, pa.int32()), pa.array(nodes, pa.int64()), pa.array(ends, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "depth", "node", "ends"])

    rows = phrases.mapInArrow(run, f"part bigint, {NODE_TYPE}")
    return rows.groupBy("part", "depth", "node").agg(F.max("ends").alias("ends"))


def _parted(phrases: DataFrame, part_nodes: int) -> tuple[DataFrame, int]:
    """``(part, phrase)`` of the distinct phrases, and the number of parts."""
    distinct = phrases.where(F.col("phrase").isNotNull() & (F.col("phrase") != "")).distinct()
    words = F.size(F.split("phrase", " "))
    firsts = distinct.groupBy(F.split("phrase", " ")[0].alias("first")).agg(F.sum(words).alias("n"))
    firsts = stage_table(firsts, "phrases-firsts")
    total = firsts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(1, -(-2 * total // part_nodes))  # twice as many as needed, so that unequal ones still fit
    if parts == 1:
        return distinct.select(F.lit(0).cast("bigint").alias("part"), "phrase"), 1
    heavy = F.broadcast(firsts.where(F.col("n") > F.lit(part_nodes // 4)).select("first", F.lit(True).alias("heavy")))  # 2 * parts words at most
    spread = distinct.withColumn("first", F.split("phrase", " ")[0]).join(heavy, "first", "left")
    by = F.when(F.col("heavy"), F.xxhash64("phrase")).otherwise(F.xxhash64("first"))
    return spread.select(F.pmod(by, F.lit(parts)).alias("part"), "phrase"), parts


def tries(phrases: DataFrame, part_nodes: int = PART_NODES) -> list[list[Level]]:
    """The levels of every part's trie."""
    parted, parts = _parted(phrases.select("phrase"), part_nodes)
    nodes = stage_table(phrase_nodes(parted), "phrases-nodes")
    out = []
    for part in range(parts):
        table = nodes.where(F.col("part") == part).select("depth", "node", "ends").toArrow()  # a part's size
        depth = table["depth"].to_numpy()
        node, ends = table["node"].to_numpy().view(np.uint64), table["ends"].to_numpy()
        levels = []
        for d in range(int(depth.max()) + 1 if len(depth) else 0):
            own = np.flatnonzero(depth == d)
            order = own[np.argsort(node[own])]
            levels.append((node[order], ends[order]))
        if levels:
            out.append(levels)
    return out


def walk(words: np.ndarray, room: np.ndarray, levels: list[Level]) -> tuple[np.ndarray, np.ndarray]:
    """Places and lengths of all hits. ``room`` is the number of words from a place to the end of its note."""
    at, node = np.arange(len(words)), np.zeros(len(words), np.uint64)
    places, lengths = [], []
    for depth, (nodes, ends) in enumerate(levels):
        inside = room[at] > depth
        at, node = at[inside], node[inside]
        if not len(at):
            break
        node = next_node(node, words[at + depth])
        slot = np.minimum(np.searchsorted(nodes, node), len(nodes) - 1)
        met = nodes[slot] == node
        at, node, slot = at[met], node[met], slot[met]
        hits = at[ends[slot]]
        places.append(hits)
        lengths.append(np.full(len(hits), depth + 1))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *places]), np.concatenate([none, *lengths])


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of ``SLICE_WORDS`` tokens or a little more: a batch has a number of notes, whatever their length."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            end = min(int(np.searchsorted(ends, before + SLICE_WORDS)) + 1, batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def _hits(notes: DataFrame, key: str, tokens: str, sent: Broadcast) -> DataFrame:
    rows = notes.select(F.col(key), F.col(tokens))
    schema = StructType([rows.schema[0]]).add("start", LongType()).add("words", LongType()).add("phrase", StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered: dict[str | None, int] = {}
        for batch in slices(batches):
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            if lists.null_count:
                sizes[lists.is_null().to_numpy(zero_copy_only=False)] = 0
            flat = lists.flatten().to_pylist()
            if len(remembered) > REMEMBERED:
                remembered.clear()
            for word in set(flat) - remembered.keys():
                remembered[word] = word_hash(word) if word is not None else 0
            hashes = np.fromiter(map(remembered.__getitem__, flat), np.uint64, len(flat))
            starts = np.cumsum(sizes) - sizes
            note = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(flat)) - np.repeat(starts, sizes)
            at, length = walk(hashes, np.repeat(sizes, sizes) - place, sent.value)
            ends = at + length
            found = [" ".join(w or "" for w in flat[a:b]) for a, b in zip(at.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(note[at])), pa.array(place[at] + 1, pa.int64()), pa.array(length, pa.int64()), pa.array(found, pa.string())],
                [key, "start", "words", "phrase"],
            )

    return rows.mapInArrow(run, schema)


def find_phrases(notes: DataFrame, key: str, phrases: DataFrame, tokens: str = "tokens", part_nodes: int = PART_NODES) -> DataFrame:
    """``(key, start, words, phrase)`` of all places where the words of a phrase stand, positions from 1.

    Notes are read once for each part of the trie; nothing is shuffled.
    """
    sc = notes.sparkSession.sparkContext
    found = None
    for levels in tries(phrases, part_nodes):
        hits = _hits(notes, key, tokens, sc.broadcast(levels))
        found = hits if found is None else found.unionByName(hits)
    return _hits(notes, key, tokens, sc.broadcast([])) if found is None else found


def match_phrases(notes: DataFrame, key: str, dictionary: DataFrame, tokens: str = "tokens", part_nodes: int = PART_NODES) -> DataFrame:
    """All senses of all dictionary phrases, of any length: one row for each hit and sense.

    ``dictionary`` has ``phrase`` and any other columns, which hits get.
    """
    dictionary = stage_table(dictionary, "phrases-dictionary")
    hits = find_phrases(notes, key, dictionary, tokens, part_nodes)
    return lookup_join(hits, dictionary, "phrase", spread_by=[key, "start", "words"], staged=True)


"""Removal of repeated byte strings by previous-factor arrays in suffix order.

A text position *repeats* when the ``width`` bytes from it also start elsewhere in the
corpus. In suffix order such positions stand together, and the previous or next smaller
position there (in document order) is an earlier match of at least ``width`` bytes: the
longest previous factor of a position is that long unless it is the first of its run.
``keep="first"`` removes positions with an earlier match; ``keep="none"`` also those that
are somebody's earlier match. Bytes covered by a removed position's string go.

Sorting every suffix of a corpus moves each byte many times, so the suffix order is
sparse and cut to depth ``width``:

1. The *anchor* of a position is the smallest hash of a ``GRAM``-byte string within its
   ``width`` bytes, the leftmost of equals. It depends on these bytes only, so equal
   strings have equal anchors at equal distance. Positions with one anchor form a
   *segment*. Blocks of documents count their anchors, and parts of the key range add
   them up (:mod:`noteforge.llm.blocks`). An anchor met once has no repeating position.
2. Blocks send each different segment of a repeated anchor once, with its bytes, to the
   part of its anchor. There the positions are put in suffix order: by anchor, by name
   of their ``width`` bytes (names by doubling, as in prefix-doubling construction), and
   then by position, so that within a run of equal strings the previous smaller position
   is the neighbour before, and the next smaller one lies outside.
3. Parts answer with the ranges of positions that repeat, and blocks remove them.

Segments that occur several times in a block are sent once; their other copies repeat
for certain. An anchor with more than ``HOT`` different segments is not gathered in
one part: its blocks send names of single positions, spread by name, instead of bytes.

Names and anchors are 64-bit hashes each, and both must agree: 128 bits.

Defined results: null texts are empty; texts shorter than ``width`` bytes keep all;
matches never cross documents. Rows that repeat a document are copies like any other
("first" is by id, nulls first, then by block and place). An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteforge.llm import blocks as B
from noteforge.llm.common import table_of
from noteforge.runtime import stage_table

WIDTH, GRAM = 200, 64
HOT = 20_000
PARTS = 4  # parts of the key range for each block: they hold an entry for each position
CHUNK = 1 << 20  # positions whose hashes are held at once
PLACE_BITS = 24

SENT_TYPE = "part bigint, block bigint, hot boolean, anchors binary, sizes binary, bytes binary, docs binary, places binary, segments binary, several binary"
RANGE_TYPE = "block bigint, segments binary, starts binary, stops binary"
RESULT_TYPE = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
KEPT_TYPE = RESULT_TYPE + ", kept binary"


def _blend(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the strings that two neighbouring strings make."""
    h = a * np.uint64(0x9E3779B97F4A7C15)
    h ^= b + np.uint64(0x632BE59BD9B4E019)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def names(data: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``gram`` and every ``width`` bytes, by doubling. ``gram <= width``."""
    h, size, grams = data.astype(np.uint64) + np.uint64(1), 1, None
    with np.errstate(over="ignore"):
        for target in (gram, width):
            while size * 2 <= target:
                h, size = _blend(h[:-size], h[size:]), size * 2
            full = h
            if size < target:
                step = target - size
                full = _blend(h[:-step], h[step:])
            grams = full if grams is None else grams
    return grams, full


def sliding_least(keys: np.ndarray, window: int) -> np.ndarray:
    """Least key of every window, from running minima of blocks of ``window`` keys."""
    n, out = len(keys), len(keys) - window + 1
    filled = np.concatenate([keys, np.full(-n % window, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, window)
    ahead = np.minimum.accumulate(filled, axis=1).ravel()
    behind = np.minimum.accumulate(filled[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:out], ahead[window - 1 : window - 1 + out])


class Segments:
    """Segments of a block: first and last position, anchor place and hash, and which are alike."""

    def __init__(self, group: pa.Table, width: int, gram: int):
        self.width = width
        self.ids, texts = B.documents_of(group)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        del texts
        found = [self._find(s, width, gram) for s in self._stretches()]
        columns = list(zip(*found)) if found else [[np.zeros(0, np.int64)]] * 2 + [[np.zeros(0, np.uint64)]] * 2
        self.first, self.last, self.anchor, name = (np.concatenate(c) for c in columns)
        # width names at both ends overlap, so with the length they tell the bytes of a segment
        _, rep, self.like, self.times = np.unique(name, return_index=True, return_inverse=True, return_counts=True)
        order = np.argsort(rep)  # different segments in the order of their first places
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.rep, self.times, self.like = rep[order], self.times[order], place[self.like]

    def _stretches(self) -> Iterator[tuple[int, int]]:
        """Runs of documents, or pieces of long ones, as ranges of positions."""
        for start in range(0, len(self.data), CHUNK):
            yield start, min(start + CHUNK, len(self.data))

    def _find(self, stretch: tuple[int, int], width: int, gram: int):
        a, b = stretch
        piece = self.data[a : min(b + width - 1, len(self.data))]
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        if len(piece) < width:
            return none
        grams, full = names(piece, width, gram)
        at = np.arange(a, a + len(full))
        doc = np.searchsorted(self.ends, at, side="right")
        inside = at + width <= self.ends[doc]  # the whole string lies in one document
        # the hash's high bits, then the place: the leftmost of equal hashes wins
        low = np.uint64((1 << PLACE_BITS) - 1)
        keys = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        least = sliding_least(keys, width - gram + 1)
        spot = (least & low).astype(np.int64)
        p = np.flatnonzero(inside)
        if not len(p):
            return none
        new = np.concatenate([[True], (spot[p[1:]] != spot[p[:-1]]) | (np.diff(p) > 1) | (doc[p[1:]] != doc[p[:-1]])])
        first, last = p[new], p[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(p) - 1]])]
        with np.errstate(over="ignore"):
            name = _blend(_blend(full[first], full[last]), (last - first).astype(np.uint64))
            # least hashes are small: mixed once more, they spread over the range of parts
            anchor = _blend(grams[spot[first]], np.uint64(0))
        return first + a, last + a, anchor, name

    def anchor_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Different anchors, and their different segments (one more if one of these occurs again)."""
        anchors = self.anchor[self.rep]
        found, place = np.unique(anchors, return_inverse=True)
        count = np.bincount(place, minlength=len(found)) + (np.bincount(place, self.times > 1, len(found)) > 0)
        return found, count

    def totals(self, sent: pa.Table) -> np.ndarray:
        """Corpus-wide counts of the anchors of the different segments."""
        found, place = np.unique(self.anchor[self.rep], return_inverse=True)
        return B.answers(sent, 0, "total")[place] if len(found) else np.zeros(0, np.int64)

    def doc_order(self, positions: np.ndarray) -> np.ndarray:
        """Document ids, as numbers that put null first."""
        least = np.iinfo(np.int64).min
        ids = np.array([least if i is None else i for i in self.ids], np.int64)
        return ids[np.searchsorted(self.ends, positions, side="right")]

    def sent(self, block: int, totals: np.ndarray, parts: int, hot: int) -> dict[str, list]:
        """Different segments of repeated anchors: with their bytes, or as names of positions."""
        out: dict[str, list] = {c.split()[0]: [] for c in SENT_TYPE.split(", ")}

        def add(is_hot: bool, part: int, anchors, sizes, data: bytes, docs, places, segments, several) -> None:
            row = (part, block, is_hot, B.pack(anchors), B.pack(sizes), data, B.pack(docs), B.pack(places), B.pack(segments), B.pack(several))
            for name, value in zip(out, row):
                out[name].append(value)

        plain = np.flatnonzero((totals > 1) & (totals <= hot))
        first, last = self.first[self.rep], self.last[self.rep]
        anchors, several = self.anchor[self.rep], (self.times > 1).astype(np.uint8)
        docs = self.doc_order(first)
        part = B.part_of(anchors, parts)
        plain = plain[np.argsort(part[plain], kind="stable")]
        cuts = np.flatnonzero(np.diff(part[plain], prepend=-1)) if len(plain) else []
        for a, b in zip(cuts, [*cuts[1:], len(plain)]):
            own = plain[a:b]
            sizes = last[own] - first[own] + self.width
            data = b"".join(self.data[f : f + s].tobytes() for f, s in zip(first[own], sizes))
            add(False, int(part[own[0]]), anchors[own], sizes.astype(np.int32), B.zstandard.ZstdCompressor(level=1).compress(data), docs[own], first[own], own.astype(np.int32), several[own])
        for some in np.array_split(np.flatnonzero(totals > hot), max(1, int((totals > hot).sum()) // 4096)):
            if not len(some):
                continue
            text = [self.data[first[s] : last[s] + self.width] for s in some]
            name = np.concatenate([names(t, self.width, 1)[1] for t in text])
            count = last[some] - first[some] + 1
            offset = np.arange(len(name)) - np.repeat(np.cumsum(count) - count, count)
            spread, owner = B.part_of(name, parts), np.repeat(some, count)
            for p in np.unique(spread):
                own = spread == p
                o = owner[own]
                add(True, int(p), anchors[o], offset[own].astype(np.int32), name[own].tobytes(), docs[o], first[o] + offset[own], o.astype(np.int32), several[o])
        return out

    def removed(self, sent: pa.Table) -> np.ndarray:
        """A mark for every byte that goes."""
        change = np.zeros(len(self.data) + 1, np.int64)
        for s, a, b in zip(*(sent[c].to_pylist() for c in ("segments", "starts", "stops"))):
            s, start, stop = B.unpack(s), B.unpack(a), B.unpack(b)
            first = self.first[self.rep][s]
            np.add.at(change, first + start, 1)
            np.add.at(change, first + stop - 1 + self.width, -1)
        copies = np.ones(len(self.first), bool)
        copies[self.rep] = False  # later copies within the block repeat for certain
        np.add.at(change, self.first[copies], 1)
        np.add.at(change, self.last[copies] + self.width, -1)
        return np.cumsum(change[:-1]) > 0


def previous_factors(anchor: np.ndarray, name: np.ndarray, owner: np.ndarray, rank: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position: has it an earlier match of full width, and any match at all?

    Positions belong to the segment ``owner``, of which ``anchor`` and the document
    order ``rank`` are given. They are put in suffix order, equal strings by position. The
    previous smaller position of a member of a run is then its neighbour; a run's first
    has none in it.
    """
    order = np.lexsort((name, anchor[owner]))
    a, n = anchor[owner[order]], name[order]
    same = (a[1:] == a[:-1]) & (n[1:] == n[:-1])
    del a, n
    run = np.concatenate([[0], np.cumsum(~same)])
    member = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    some, runs = order[member], run[member]
    some = some[np.lexsort((place[some], rank[owner[some]], runs))]
    earlier, matched = np.zeros(len(name), bool), np.zeros(len(name), bool)
    matched[some] = True
    if len(some):
        earlier[some] = np.concatenate([[False], runs[1:] == runs[:-1]])
    return earlier, matched


class Gathered:
    """What blocks sent to a part: columns of segments, and of their positions."""

    def __init__(self, rows: list[dict], width: int):
        columns: dict[str, list[np.ndarray]] = {c: [] for c in ("anchors", "docs", "block", "places", "segments", "several", "owner", "offset", "name")}
        base = 0
        for row in rows:
            found = {c: B.unpack(row[c]) for c in ("anchors", "sizes", "docs", "places", "segments", "several")}
            sizes = found.pop("sizes")
            many = len(sizes)
            if row["hot"]:  # a segment entry for each position
                owner, offset, name = np.arange(many), sizes, np.frombuffer(row["bytes"], np.uint64)
                found["places"] = found["places"] - sizes
            else:
                owner, offset, name = self._positions(row["bytes"], sizes.astype(np.int64), width)
            found |= {"block": np.full(many, row["block"]), "owner": (owner + base).astype(np.int32), "offset": offset.astype(np.int32), "name": name}
            for c, v in found.items():
                columns[c].append(v)
            base += many
        for c, v in columns.items():
            setattr(self, c, np.concatenate(v))
            v.clear()

    @staticmethod
    def _positions(data: bytes, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        text = np.frombuffer(B.zstandard.ZstdDecompressor().decompress(data), np.uint8)
        ends, count, found = np.cumsum(sizes), sizes - width + 1, []
        step = max(1, CHUNK // (2 * width))
        for i in range(0, len(sizes), step):
            a, b = ends[i] - sizes[i], ends[min(i + step, len(sizes)) - 1]
            n = count[i : i + step]
            starts = ends[i : i + step] - sizes[i : i + step] - a
            found.append(names(text[a:b], width, 1)[1][np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        owner = np.repeat(np.arange(len(sizes), dtype=np.int32), count)
        return owner, np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count), np.concatenate(found)

    def going(self, keep: str) -> np.ndarray:
        order = np.lexsort((self.block, self.docs))  # documents by id, then by block
        new = (np.diff(self.docs[order]) != 0) | (np.diff(self.block[order]) != 0)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(new)])
        anchor = np.unique(self.anchors, return_inverse=True)[1].astype(np.int32)
        place = self.places[self.owner] + self.offset
        earlier, matched = previous_factors(anchor, self.name, self.owner, rank, place)
        return earlier if keep == "first" else matched | (self.several > 0)[self.owner]


def _ranges(width: int, keep: str):
    def run(group):
        got = Gathered(group.to_pylist(), width)
        at = np.flatnonzero(got.going(keep))
        b, s, o = got.block[got.owner[at]], got.segments[got.owner[at]], got.offset[at]
        order = np.lexsort((o, s, b))
        b, s, o = b[order], s[order], o[order]
        out: dict[str, list] = {"block": [], "segments": [], "starts": [], "stops": []}
        if len(b):
            new = np.concatenate([[True], (np.diff(b) != 0) | (np.diff(s) != 0) | (np.diff(o) != 1)])
            heads = np.flatnonzero(new)
            tails = np.concatenate([heads[1:] - 1, [len(b) - 1]])
            for one in np.unique(b):
                own = b[heads] == one
                h, t = heads[own], tails[own]
                for c, v in zip(out, (int(one), B.pack(s[h]), B.pack(o[h].astype(np.int32)), B.pack((o[t] + 1).astype(np.int32)))):
                    out[c].append(v)
        return table_of(out, RANGE_TYPE)

    return run


def _results(segments: Segments, goes: np.ndarray, with_text: bool) -> dict[str, list]:
    out: dict[str, list] = {c.split()[0]: [] for c in KEPT_TYPE.split(", ")}
    for doc_id, size, end in zip(segments.ids, segments.sizes.tolist(), segments.ends.tolist()):
        mark, data = goes[end - size : end], segments.data[end - size : end]
        kept = data[~mark].tobytes()
        spans = int(mark[:1].sum()) + int((mark[1:] & ~mark[:-1]).sum())
        row = (doc_id, size, size - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None)
        for name, value in zip(out, row):
            out[name].append(value)
    return out


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM, keep: str = "first",
    with_text: bool = True, hot: int = HOT, block_bytes: int = B.BLOCK_BYTES,
) -> DataFrame:
    """One row per document: bytes, removed bytes and runs, SHA-256 of what is kept and, if asked for, these bytes."""
    if keep not in ("first", "none"):
        raise ValueError(f"keep is first or none, not {keep!r}")
    if not 1 <= gram <= width:
        raise ValueError("gram must be 1 to width")
    n_blocks = parts = B.block_count(docs, text, block_bytes)
    blocks = B.to_blocks(docs, n_blocks, doc_id, text)

    def count(block: int, group: pa.Table) -> dict[str, list]:
        return B.key_rows(0, block, *Segments(group, width, gram).anchor_counts(), parts)

    def send(block: int, group: pa.Table, sent: pa.Table) -> dict[str, list]:
        segments = Segments(group, width, gram)
        return segments.sent(block, segments.totals(sent), PARTS * parts, hot)

    def finish(block: int, group: pa.Table, sent: pa.Table) -> dict[str, list]:
        segments = Segments(group, width, gram)
        return _results(segments, segments.removed(sent), with_text)

    anchors = stage_table(B.sum_keys(B.per_block(blocks, count, B.KEY_TYPE)), "repeats-anchors")
    sent = B.with_answers(blocks, anchors, send, SENT_TYPE)
    ranges = stage_table(sent.groupBy("part").applyInArrow(_ranges(width, keep), RANGE_TYPE), "repeats-ranges")
    result = B.with_answers(blocks, ranges, finish, KEPT_TYPE)
    return result if with_text else result.drop("kept")

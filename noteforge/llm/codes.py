"""Product codes of vectors by Lloyd's algorithm over cover trees.

Components become integers, vectors are cut into ``parts`` equal runs, and every run
has a codebook of its own. Rows are put into blocks of ``BLOCK`` vectors where they lie.
For each run a block holds a cover tree: the children of a node of radius r are points
of it, more than r / 2 apart, that cover the node's points within r / 2; nodes of ``LEAF``
points or fewer, and those of equal points, aren't cut further. A node's points are
neighbours in the tree's order, so cumulative sums along it give the sum of any subtree.

A round walks the trees of a block down from the root. Let ``near`` and ``next`` be the
distances of a node's centre to the nearest and to the second nearest entry. Where
near + 2 r < next, every point of the node is nearer to the one than to all others, by the
triangle inequality: the whole subtree is assigned, and its sum and count are read off.
Otherwise its children are tried, and the points of an ambiguous leaf are compared with
every entry exactly. Sums combine in each task and are added by part and entry; only
codebooks (``parts * entries`` entries) reach the driver. Blocks are a table in the shared
folder, so a lost executor costs the blocks it was working on.

All distances and sums are exact: in doubles where no square can pass 2**53, in Python's
integers otherwise. The tree is built in doubles, with radii rounded up.

Defined results: null vectors and those with null or non-finite components take no part.
Vectors shorter than the longest count as padded with zeros, up to a multiple of
``parts``. Fewer rows than entries give fewer entries. Among rows of one id, the smaller
vector comes first; null ids come last. Ties go to the lower entry. An error beyond a
long is the largest long. Null labels are one group. Rows that repeat an id are coded one
by one. An empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteforge.llm.common import chunks_of
from noteforge.operators.joins import lookup_join
from noteforge.runtime import stage_table

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
BLOCK, LEAF = 4096, 32
LONG_MAX = (1 << 63) - 1
EXACT = float(1 << 53)
LIMB = 32
BLOCK_TYPE = "ids array<bigint>, labels array<string>, points binary, orders binary, nodes binary, radii binary"
SUM_TYPE = "part int, entry int, place int, limb int, value bigint"
CODE_TYPE = "id bigint, label string, code string, error bigint"

# --- cover trees ---------------------------------------------------------------


@dataclass(frozen=True)
class Tree:
    """``nodes`` has a row (start, end, centre, first child, children) each; a node's points are ``order[start:end]``."""

    order: np.ndarray
    nodes: np.ndarray
    radii: np.ndarray


def _distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - centre) ** 2).sum(axis=1))


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """A cover tree of the rows of ``points``; the children of a node stand together, after it."""
    n = len(points)
    order = np.arange(n)
    nodes, radii = [[0, n, 0, 0, 0]], [0.0]
    if n:
        radii[0] = float(_distances(points, points[0]).max()) * (1 + 1e-9)
    at = 0
    while at < len(nodes):
        start, end, centre, _, _ = nodes[at]
        if end - start > leaf and radii[at] > 0:
            half, left = radii[at] / 2, order[start:end].copy()
            first, place, head = len(nodes), start, centre
            while len(left):
                d = _distances(points[left], points[head])
                inside = d <= half
                own = left[inside]
                order[place : place + len(own)] = own
                nodes.append([place, place + len(own), int(head), 0, 0])
                radii.append(float(d[inside].max()) * (1 + 1e-9))
                place += len(own)
                left = left[~inside]
                head = left[0] if len(left) else 0
            nodes[at][3:] = [first, len(nodes) - first]
        at += 1
    return Tree(order.astype(np.int32), np.array(nodes, np.int32).reshape(-1, 5), np.array(radii))


def squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances, a row for each point; both are doubles or both Python integers."""
    out = np.zeros((len(points), len(entries)), points.dtype)
    for j in range(points.shape[1]):
        out += (points[:, j, None] - entries[None, :, j]) ** 2
    return out


def assign(tree: Tree, points: np.ndarray, entries: np.ndarray) -> tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray]:
    """Whole subtrees as ``(start, end, entry)``, and the single points of ambiguous leaves with their entries."""
    whole: list[tuple[int, int, int]] = []
    single, of_single = [], []
    front = np.zeros(1 if len(points) else 0, np.int64)
    while len(front):
        nodes, radii = tree.nodes[front], tree.radii[front]
        exact = squares(points[nodes[:, 2]], entries)
        best = exact.argmin(axis=1)  # the lower entry of equal ones
        d = np.sqrt(exact.astype(np.float64))
        near = d[np.arange(len(d)), best]
        d[np.arange(len(d)), best] = np.inf
        far = d.min(axis=1)
        sure = (radii == 0) | (near + 2 * radii + 1e-9 * (near + radii) < far * (1 - 1e-9))
        whole += [(int(s), int(e), int(b)) for (s, e), b in zip(nodes[sure, :2], best[sure])]
        rest = nodes[~sure]
        ends = rest[rest[:, 4] == 0]
        if len(ends):
            open_points = np.concatenate([tree.order[s:e] for s, e in ends[:, :2]])
            single.append(open_points)
            of_single.append(squares(points[open_points], entries).argmin(axis=1))
        inner = rest[rest[:, 4] > 0]
        front = np.concatenate([np.arange(a, a + k) for a, k in inner[:, 3:]]) if len(inner) else np.zeros(0, np.int64)
    empty = np.zeros(0, np.int64)
    return whole, np.concatenate([empty, *single]), np.concatenate([empty, *of_single])


def _sums(tree: Tree, points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts and sums (Python integers) of each entry's points."""
    whole, single, of_single = assign(tree, points, entries)
    running = np.concatenate([np.zeros((1, points.shape[1]), points.dtype), np.cumsum(points[tree.order], axis=0)])
    counts, sums = np.zeros(len(entries), np.int64), np.zeros((len(entries), points.shape[1]), object)
    for start, end, entry in whole:
        counts[entry] += end - start
        sums[entry] += _integers(running[end] - running[start])
    for entry in np.unique(of_single):
        own = single[of_single == entry]
        counts[entry] += len(own)
        sums[entry] += _integers(points[own].sum(axis=0))
    return counts, sums


def _assigned(tree: Tree, points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The entry of every point."""
    whole, single, of_single = assign(tree, points, entries)
    out = np.zeros(len(points), np.int64)
    for start, end, entry in whole:
        out[tree.order[start:end]] = entry
    out[single] = of_single
    return out


def _integers(values: np.ndarray) -> np.ndarray:
    return np.array([int(v) for v in values.ravel()], object).reshape(values.shape)


# --- blocks --------------------------------------------------------------------


def _blocks(rows: DataFrame, parts: int, width: int) -> DataFrame:
    """``(id, label, v)`` as blocks with a tree for each part."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in chunks_of(batch.num_rows, BLOCK):
                ids, labels, vectors = (c[at] for c in batch.columns)
                points = np.zeros((len(ids), parts * width))
                sizes = np.diff(vectors.offsets.to_numpy())
                flat = vectors.flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(sizes)), sizes)
                column = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                points[row, column] = flat
                trees = [cover_tree(points[:, p * width : (p + 1) * width]) for p in range(parts)]
                counts = np.array([len(t.nodes) for t in trees], np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids.to_pylist()], pa.list_(pa.int64())),
                        pa.array([labels.to_pylist()], pa.list_(pa.string())),
                        pa.array([points.tobytes()], pa.binary()),
                        pa.array([np.concatenate([t.order for t in trees]).tobytes()], pa.binary()),
                        pa.array([np.concatenate([counts, *[t.nodes.ravel() for t in trees]]).tobytes()], pa.binary()),
                        pa.array([np.concatenate([t.radii for t in trees]).tobytes()], pa.binary()),
                    ],
                    ["ids", "labels", "points", "orders", "nodes", "radii"],
                )

    return rows.mapInArrow(build, BLOCK_TYPE)


def _opened(batches: Iterator[pa.RecordBatch], parts: int, exact: bool) -> Iterator[tuple[list, list, list[tuple[Tree, np.ndarray]]]]:
    """Ids, labels, and for each part its tree and points."""
    for batch in batches:
        for ids, labels, points, orders, nodes, radii in zip(*(c.to_pylist() for c in batch.columns)):
            n = len(ids)
            values = np.frombuffer(points).reshape(n, -1)
            width = values.shape[1] // parts
            order = np.frombuffer(orders, np.int32).reshape(parts, n)
            numbers = np.frombuffer(nodes, np.int32)
            counts, table, radius = numbers[:parts], numbers[parts:].reshape(-1, 5), np.frombuffer(radii)
            ends = np.cumsum(counts)
            trees = []
            for p in range(parts):
                own = slice(ends[p] - counts[p], ends[p])
                mine = values[:, p * width : (p + 1) * width]
                trees.append((Tree(order[p], table[own], radius[own]), mine if exact else _integers(mine)))
            yield ids, labels, trees


def _round(blocks: DataFrame, books: list[np.ndarray], exact: bool) -> list[np.ndarray]:
    """The codebooks after one round. Entries without a point stay."""
    parts, (entries, width) = len(books), books[0].shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [b.astype(np.float64) if exact else b for b in books]
        counts = np.zeros((parts, entries), np.int64)
        sums = np.zeros((parts, entries, width), object)
        for _, _, trees in _opened(batches, parts, exact):
            for p, (tree, points) in enumerate(trees):
                n, s = _sums(tree, points, own[p])
                counts[p] += n
                sums[p] += s
        rows = []
        for p, e in zip(*np.nonzero(counts)):
            rows.append((p, e, -1, 0, counts[p, e]))
            for j, value in enumerate(sums[p, e]):
                size, limb = abs(value), 0
                while size:
                    rows.append((p, e, j, limb, (size & ((1 << LIMB) - 1)) * (1 if value > 0 else -1)))
                    size, limb = size >> LIMB, limb + 1
        columns = list(zip(*rows)) or [[]] * 5
        kinds = [pa.int32()] * 4 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([int(x) for x in c], k) for c, k in zip(columns, kinds)], ["part", "entry", "place", "limb", "value"])

    total = blocks.mapInArrow(add, SUM_TYPE).groupBy("part", "entry", "place", "limb").agg(F.sum("value").alias("value"))
    found: dict[tuple[int, int, int], int] = {}
    for r in total.collect():  # as many rows as the codebooks have components, for each 32 bits of a sum
        key = (r["part"], r["entry"], r["place"])
        found[key] = found.get(key, 0) + (int(r["value"]) << (LIMB * r["limb"]))
    out = []
    for p, book in enumerate(books):
        new = book.copy()
        for e in range(entries):
            if n := found.get((p, e, -1)):
                new[e] = [found.get((p, e, j), 0) // n for j in range(width)]
        out.append(new)
    return out


def _coded(blocks: DataFrame, books: list[np.ndarray], exact: bool) -> DataFrame:
    parts = len(books)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [b.astype(np.float64) if exact else b for b in books]
        for ids, labels, trees in _opened(batches, parts, exact):
            entry = np.zeros((len(ids), parts), np.uint8)
            error = np.zeros(len(ids), np.int64 if exact else object)
            for p, (tree, points) in enumerate(trees):
                entry[:, p] = _assigned(tree, points, own[p])
                square = ((points - own[p][entry[:, p]]) ** 2).sum(axis=1)
                error = error + (square.astype(np.int64) if exact else square)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(labels, pa.string()),
                    pa.array([row.tobytes().hex() for row in entry], pa.string()),
                    pa.array([min(int(x), LONG_MAX) for x in error], pa.int64()),
                ],
                ["id", "label", "code", "error"],
            )

    return blocks.mapInArrow(code, CODE_TYPE)


# --- the operator --------------------------------------------------------------


def vector_codes(
    table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes of all usable rows as ``(id, label, code, error)``, and the final codebooks; ``entries`` is 256 at most."""
    if not 1 <= entries <= 256:
        raise ValueError("a code is two hex digits: 1 to 256 entries")
    doubles = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double"))
    large = F.transform(vector, lambda x: x.cast("double") * F.lit(float(scale)))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    small = F.forall(large, lambda x: F.abs(x) < EXACT)  # a larger double is whole, and floor() gives a long
    rows = table.where(F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull()) & F.forall(large, finite)).select(
        F.col(key).cast("bigint").alias("id"), F.col(label).cast("string").alias("label"),
        F.when(small, doubles).otherwise(F.transform(large, lambda x: F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x))).alias("v"),
    )
    rows = stage_table(rows, "codes-vectors")
    biggest = F.array_max(F.transform("v", lambda x: F.abs(x)))
    width, size = rows.agg(F.max(F.size("v")), F.max(biggest)).first()
    width = max(1, -(-(width or 0) // parts))
    exact = 4.0 * width * (size or 0.0) ** 2 < EXACT and BLOCK * (size or 0.0) < EXACT
    blocks = stage_table(_blocks(rows, parts, width), "codes-blocks")
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()  # ``entries`` vectors
    start = np.zeros((len(first), parts * width), object)
    for i, r in enumerate(first):
        start[i, : len(r["v"])] = [int(x) for x in r["v"]]
    books = [start[:, p * width : (p + 1) * width] for p in range(parts)]
    if first:
        for _ in range(rounds):
            books = _round(blocks, books, exact)
    return _coded(blocks, books, exact), books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Add ``label_error``: the errors of all rows of the same label; null labels are one group."""
    coded = stage_table(coded.withColumn("_l", F.coalesce(F.concat(F.lit("="), "label"), F.lit(""))), "codes-coded")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG_MAX).cast("decimal(38,0)")).cast("bigint")
    sums = coded.groupBy("_l").agg(total.alias("label_error"))
    return lookup_join(coded, sums, "_l", spread_by=["id", "code"]).drop("_l")


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for book in books for x in book.ravel()).encode()).hexdigest()

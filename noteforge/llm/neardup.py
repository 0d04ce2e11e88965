"""Near-duplicate classes by order min-hash and banded alignment.

Words are those of :mod:`noteforge.llm.leaks`. The similarity of two texts is 1 - d / n for an
edit distance of d words (insertions, deletions, replacements) and n words in the longer text.
Texts at ``THRESHOLD`` or more are linked, and classes are the connected texts.

1. Texts with the same words are one text from here on (grouped by 128 bits of hash).
2. Order min-hash: each of ``SKETCHES`` hash functions picks the ``PICKS`` smallest of a text's
   occurrence-labelled shingles (runs of ``SHINGLE`` words); these, in text order, are a sketch.
   Texts with an equal sketch share a bucket. Where a tenth of the words differ, two texts
   share about two shingles in five, and one sketch in thirteen agrees: with 40, all of them
   differ in one pair of twenty; where a twentieth differs, in one of a hundred thousand.
3. A bucket's centre is the member that shares most buckets with others, as the original of
   many copies does. Each text is proposed to the heaviest centre among its buckets. Links that
   stand up to alignment are united by alternating large and small stars (of centres only, as
   other members just hang on one); a group of copies is one class from here on, at the cost of
   one pair for each text.
4. Then members of different classes in one bucket are compared, in one pass over the buckets that
   hold several classes. Members are cut into classes of size (no link crosses more than one
   border) and into blocks of ``BLOCK``; the largest class of a bucket, which often holds nearly all
   of it, goes to the others' blocks only. A task holds the words of two blocks. It leaves out
   pairs that meet in an earlier bucket too, and bounds what the others can share by a matrix
   product of hashed counts of word pairs: d edits leave n - 1 - 2 d word pairs alike. Of the pairs
   that pass, each class names its most promising one, these are aligned, and classes united;
   then it names ``MORE`` times as many, until none has any left. Only links leave the task.

So every pair that shares a sketch is compared or already in one class, and no bucket's pairs
are written out. A centre's words are sent to ``SLOTS`` places at most, and its pairs are spread
over these. Tables of a step are deleted once the next one stands.

Alignment: bags of words bound the distance first, then equal ends are trimmed, and the rest is
aligned in bit vectors of a band around the diagonal, which is widened until the distance fits.

Defined results: null texts and texts without a word are classes of their own. Texts of fewer
words than a shingle are linked to equal ones only. A class is named by its smallest document
id, nulls first; rows that share an id count as one document, compared by the least of its texts
where they differ. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteforge.llm.common import map_arrow
from noteforge.llm.leaks import WORD_BYTES
from noteforge.runtime import Workspace

SHINGLE, THRESHOLD = 5, 0.8
SKETCHES, PICKS = 40, 3
SLOTS = 256
BLOCK, BLOCK_BYTES = 512, 4 << 20
MORE = 8  # times as many pairs of a class in the next turn
NARROW, WIDER = 32, 4  # the first band, and how much wider the next one is
MANY = 64  # places of a word from which on they are one number
LONG = 8192  # word pairs beyond which a text isn't bounded by them
NO_ID = -(1 << 63)
SKETCH_TYPE = "struct<e1:bigint,e2:bigint,bands:array<bigint>>"

_RNG = np.random.default_rng(11)
_MASKS = _RNG.integers(0, 1 << 63, SKETCHES, np.uint64)
_FACTORS = _RNG.integers(0, 1 << 63, SKETCHES, np.uint64) * np.uint64(2) + np.uint64(1)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def word_bytes(text: str | None) -> bytes:
    """The words of a text between single blanks."""
    return b" ".join((text or "").encode().translate(WORD_BYTES).split())


def word_hashes(words: bytes) -> np.ndarray:
    found = words.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def shingles(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of ``size`` words; of all words where there are fewer."""
    n = len(hashes)
    if not n:
        return hashes
    size = min(size, n)
    h = np.zeros(n - size + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            h = h * _GOLD + hashes[i : n - size + 1 + i]
        return _mix(h + np.uint64(size))


def labelled(h: np.ndarray) -> np.ndarray:
    """Each shingle mixed with how often it stood before."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    if new.all():
        return h
    at = np.arange(len(h))
    nth = np.empty(len(h), np.uint64)
    nth[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    with np.errstate(over="ignore"):
        return np.where(nth > 0, _mix(h + nth * _GOLD), h)


def sketches(h: np.ndarray) -> np.ndarray:
    """Order min-hashes of labelled shingles."""
    picks = min(PICKS, len(h))
    out = np.zeros(SKETCHES, np.uint64)
    with np.errstate(over="ignore"):
        step = max(1, (1 << 19) // len(h))
        for a in range(0, SKETCHES, step):
            y = (h[None, :] ^ _MASKS[a : a + step, None]) * _FACTORS[a : a + step, None]
            low = np.argpartition(y, picks - 1, axis=1)[:, :picks] if len(h) > picks else np.tile(np.arange(len(h)), (len(y), 1))
            chosen = h[np.sort(low, axis=1)]  # in text order
            value = np.arange(a, a + len(y), dtype=np.uint64)
            for i in range(picks):
                value = _mix(value * _GOLD + chosen[:, i])
            out[a : a + len(y)] = value
    return out


def sketch_udf():
    @F.arrow_udf(SKETCH_TYPE)
    def sketch(texts: pa.Array) -> pa.Array:
        e1, e2, bands = [], [], []
        for text in texts.to_pylist():
            words = word_bytes(text)
            if not words:
                e1.append(None), e2.append(None), bands.append(None)
                continue
            e1.append(xxhash.xxh3_64_intdigest(words) - (1 << 63))
            e2.append(xxhash.xxh64_intdigest(words) - (1 << 63))
            bands.append(sketches(labelled(shingles(word_hashes(words)))).view(np.int64))
        return pa.StructArray.from_arrays(
            [pa.array(e1, pa.int64()), pa.array(e2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["e1", "e2", "bands"]
        )

    return sketch


# --- alignment -----------------------------------------------------------------


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Words that both have, with repeats."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int(np.minimum(n[i], m[j]).sum())


def _places(rows: list[int]) -> dict[int, list[int] | int]:
    """Places of each word: a list, or a number with a bit for each where there are many."""
    out: dict[int, list[int] | int] = {}
    for i, x in enumerate(rows):
        out.setdefault(x, []).append(i)  # type: ignore[union-attr]
    for x, places in out.items():
        if len(places) > MANY:
            bits = bytearray(len(rows) // 8 + 1)
            for i in places:
                bits[i >> 3] |= 1 << (i & 7)
            out[x] = int.from_bytes(bits, "little")
    return out


def _banded(a: list[int], b: list[int], places: dict[int, list[int] | int], band: int) -> int:
    """Edit distance of ``a`` and ``b`` if it is ``band`` or less, else ``band + 1``.

    Bit ``i`` of a step's vectors stands for the row ``band`` above the diagonal plus ``i``; the
    window moves down a row with each step. ``up`` and ``down`` are the places where the distance
    rises or falls from row to row. The distance is followed along the lower edge of the band,
    and then along the last row.
    """
    m, n = len(a), len(b)
    if abs(m - n) > band:
        return band + 1
    width = 2 * band + 1
    full, low = (1 << width) - 1, 1 << (width - 1)
    up, down, distance = ((1 << (band + 1)) - 1) << band, 0, min(band, m)
    if m <= band:  # the last row is in the window from the start
        up &= (1 << (band + m)) - 1
    for j in range(1, n + 1):
        top = j - band - 1  # the word in the window's first row
        found = places.get(b[j - 1])
        if found is None:
            same = 0
        elif isinstance(found, int):
            same = (found >> top if top >= 0 else found << -top) & full
        else:
            same = 0
            for i in range(bisect_left(found, top), len(found)):
                if found[i] >= top + width:
                    break
                same |= 1 << (found[i] - top)
        zero = (((same & up) + up) ^ up) | same | down
        right_up = down | (full & ~(zero | up))
        right_down = zero & up
        if j + band <= m:
            distance += not zero & low
        else:
            last = 1 << (m - 1 - top)
            if right_up & last:
                distance += 1
            elif right_down & last:
                distance -= 1
        if distance - max(0, min(n - j, n - m + band)) > band:
            return band + 1
        zero >>= 1
        up = right_down | (full & ~(zero | right_up))
        down = zero & right_up
    return min(distance, band + 1)


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Words to insert, delete or replace; ``most + 1`` if these are more than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    n = min(len(a), len(b))
    unlike = np.flatnonzero(a[:n] != b[:n])
    head = int(unlike[0]) if len(unlike) else n
    unlike = np.flatnonzero(a[len(a) - n + head :][::-1] != b[len(b) - n + head :][::-1])
    tail = int(unlike[0]) if len(unlike) else n - head
    x, y = a[head : len(a) - tail].tolist(), b[head : len(b) - tail].tolist()
    if not x or not y:
        return min(max(len(x), len(y)), most + 1)
    places, band = _places(x), min(NARROW, most)
    while True:
        found = _banded(x, y, places, band)
        if found <= band or band >= most:
            return min(found, most + 1)
        band = min(band * WIDER, most)


def edits_allowed(n: int, threshold: float) -> int:
    """The largest distance at which two texts, the longer of ``n`` words, are linked."""
    return int(np.floor((1 - threshold) * n + 1e-9))


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Edit similarity of two word sequences; 0 where it is below the threshold."""
    n = max(len(a), len(b))
    if not min(len(a), len(b)):
        return 0.0
    most = edits_allowed(n, threshold)
    if n - min(len(a), len(b)) > most or n - _shared(a, b) > most:
        return 0.0
    found = edit_distance(a, b, most)
    return 1 - found / n if found <= most else 0.0


def similar_udf(threshold: float):
    @F.arrow_udf("double")
    def similar(left: pa.Array, right: pa.Array) -> pa.Array:
        seen: dict[bytes, np.ndarray] = {}
        out = []
        for a, b in zip(left.to_pylist(), right.to_pylist()):
            if a not in seen:  # a centre's pairs stand together
                seen = {a: word_hashes(a)}
            out.append(similarity(seen[a], word_hashes(b), threshold))
        return pa.array(out, pa.float64())

    return similar


def word_pairs(h: np.ndarray) -> bytes | None:
    """16 bits of each word pair; none of very long texts."""
    return (shingles(h, 2) >> np.uint64(48)).astype(np.uint16).tobytes() if 2 <= len(h) <= LONG else None


def _counts(grams: list[bytes | None], slots: int) -> np.ndarray:
    out = np.zeros((len(grams), slots), np.float32)
    for i, g in enumerate(grams):
        if g is not None:
            out[i] = np.bincount(np.frombuffer(g, np.uint16) % slots, minlength=slots)
    return out


def reachable(size: np.ndarray, grams: list[bytes | None], threshold: float) -> np.ndarray:
    """How many more word pairs than needed two members of a block can share, as a share of the longer one's words.

    Minus infinity only where sizes or shared word pairs forbid that they are similar.
    """
    n = np.maximum(size[:, None], size[None, :])
    allowed = np.floor((1 - threshold) * n + 1e-9)
    fit = n - np.minimum(size[:, None], size[None, :]) <= allowed
    known = np.array([g is not None for g in grams])
    most = max((len(g) // 2 for g in grams if g is not None), default=0)
    slots = 1024
    while slots < 8 * most and slots < 16384:
        slots *= 2
    counts = _counts(grams, slots)
    shared = counts @ counts.T  # at least as many as the word pairs that both have
    shared[~known[:, None] | ~known[None, :]] = np.inf
    spare = np.minimum(shared - (n - 1 - 2 * allowed), n)
    return np.where(fit & (spare >= -1e-3), spare / np.maximum(n, 1), -np.inf)


# --- classes -------------------------------------------------------------------


def connected(edges: DataFrame, work: Workspace | None = None) -> DataFrame:
    """``(node, root)`` of the nodes of ``(a, b)`` edges: the smallest node each is connected to.

    Alternating stars: hang every larger neighbour on the smallest one, then every
    node and its smaller neighbours, until nothing moves.
    """
    work = work or Workspace(edges.sparkSession, "connected")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    links = work.put(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    seen = mark(links)
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x"))
            .select(F.col("x.b").alias("a"), F.col("x.m").alias("b")).where("a <> b").distinct()
        )
        links = work.put(small, "stars")
        now = mark(links)
        if now == seen:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now


def united(links: DataFrame, work: Workspace) -> DataFrame:
    """``(node, root)`` of links ``(a, b)`` of centres and members; a root is the smallest node of its class.

    A member hangs on its smallest centre; what is left to connect are centres that share a
    member, of which there are few.
    """
    low = links.groupBy("b").agg(F.min("a").alias("m"))
    own = work.put(links.join(low, "b").select("a", "b", "m"), "hung")
    centres = own.select(F.col("a").alias("b")).distinct()
    edges = own.where("a <> m").select("a", F.col("m").alias("b")).unionByName(
        low.join(centres, "b", "left_semi").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    )
    tops = work.put(connected(edges.distinct(), work), "tops")
    hung = own.select(F.col("b").alias("node"), "m").distinct().join(centres, F.col("node") == F.col("b"), "left_anti")
    hung = hung.unionByName(centres.select(F.col("b").alias("node"), F.col("b").alias("m")))
    named = work.put(hung.join(tops.withColumnRenamed("node", "m"), "m", "left").select("node", F.coalesce("root", "m").alias("top")), "named")
    least = named.groupBy("top").agg(F.least(F.min("node"), F.col("top")).alias("root"))
    out = work.put(named.join(least, "top").select("node", "root"), "roots")
    work.remove("hung", "tops", "named", "stars")
    return out


def joined(root: DataFrame, more: DataFrame, work: Workspace) -> DataFrame:
    """``root`` with the classes united that the links ``more`` join; nodes that had no link yet get a row."""
    end = lambda df, c: df.join(root.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")), c, "left").withColumn(f"r{c}", F.coalesce(f"r{c}", c))
    met = end(end(more, "a"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
    tops = work.put(connected(met, work), "tops").withColumnRenamed("root", "top")
    old = root.join(tops.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    new = tops.join(root.select("node"), "node", "left_anti").select("node", F.col("top").alias("root"))
    out = work.put(old.unionByName(new), "roots")
    work.remove("tops", "stars")
    return out


def _verified(pairs: DataFrame, words: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``(a, b)`` whose texts reach the threshold."""
    pairs = pairs.withColumn("slot", F.pmod(F.xxhash64("b"), F.lit(SLOTS)))
    centres = pairs.select("a", "slot").distinct().join(words.select(F.col("node").alias("a"), F.col("words").alias("left")), "a")
    members = pairs.join(words.select(F.col("node").alias("b"), F.col("words").alias("right")), "b")
    met = members.join(centres, ["a", "slot"])
    return met.withColumn("s", similar_udf(threshold)("left", "right")).where(F.col("s") > 0).select("a", "b")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, class_id)``: one row per row of ``docs``."""
    work = Workspace(docs.sparkSession, "neardup")
    key = F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID))
    rows = docs.select(key.alias("id"), F.col(text).alias("text"))
    sketched = work.put(rows.withColumn("s", sketch_udf()("text")).select("id", "s.e1", "s.e2", "s.bands"), "sketches")
    nodes = (
        sketched.where("bands IS NOT NULL").groupBy("e1", "e2")
        .agg(F.min("id").alias("node"), F.first("bands").alias("bands"))
    )
    buckets = nodes.select("node", F.explode("bands").alias("value"))  # a value tells its band
    shared = buckets.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = work.put(buckets.join(shared, "value").select("value", "node", "n"), "members")
    ids = work.put(nodes.select("e1", "e2", "node"), "ids")
    involved = members.select(F.col("node").alias("id")).distinct()
    as_words = F.arrow_udf("binary")(lambda t: pa.array([word_bytes(x) for x in t.to_pylist()], pa.binary()))
    found = rows.join(involved, "id").select(F.col("id").alias("node"), as_words("text").alias("words"))
    repeat = _ids_repeat(sketched)
    words = work.put(found.groupBy("node").agg(F.min("words").alias("words")) if repeat else found, "words")
    tried = work.put(_proposed(members), "tried")
    links = work.put(_verified(tried, words, threshold), "links")
    root = united(links, work)
    left = work.put(_apart(members, root), "apart")
    if not left.isEmpty():
        # of an id that repeats, one of any number of buckets
        own = F.array(F.min("value")) if repeat else F.collect_set("value")
        held = work.put(words.join(left.groupBy("node").agg(own.alias("values")), "node").withColumn("size", _n_words("words")), "held")
        more = work.put(_within(left, held, threshold), "more")
        if not more.isEmpty():
            root = joined(root, more, work)
    classes = ids.join(root, "node", "left").select("e1", "e2", F.coalesce("root", "node").alias("root"))
    out = sketched.join(classes, ["e1", "e2"], "left").select("id", F.coalesce("root", "id").alias("c"))
    done = work.put(out.select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), F.nullif("c", F.lit(NO_ID)).alias("class_id")), "classes")
    work.keep_only("classes")
    return done


def _ids_repeat(sketched: DataFrame) -> bool:
    return not sketched.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def _n_words(words: str):
    """How many words stand between single blanks."""
    blanks = F.octet_length(words) - F.octet_length(F.translate(F.col(words).cast("string"), " ", ""))
    return F.when(F.octet_length(words) > 0, blanks + 1).otherwise(0).cast("bigint")


def _proposed(members: DataFrame) -> DataFrame:
    """Pairs ``(a, b)``: every member with the heaviest centre that it meets in a bucket; one pair for a member."""
    weights = members.groupBy("node").agg(F.sum("n").alias("weight"))
    first = F.min(F.struct((-F.col("weight")).alias("w"), "node"))
    centres = members.select("value", "node").join(weights, "node").groupBy("value").agg(first.alias("c"))
    met = members.select("value", "node").join(centres, "value").where("c.node <> node")
    return met.groupBy("node").agg(F.min("c").alias("c")).select(F.col("c.node").alias("a"), F.col("node").alias("b"))


def _apart(members: DataFrame, root: DataFrame) -> DataFrame:
    """Members of the buckets that hold several classes, with their classes."""
    placed = members.select("value", "node").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = placed.groupBy("value").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    return placed.join(several.select("value"), "value")


def _within(apart: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """Links ``(a, b)`` of members of one bucket and different classes; not those that other links of the group imply."""
    # a link joins neighbouring classes of size at most: members are guests in the next one
    border = float(np.log(1 / threshold) * (1 + 1e-9)) if threshold < 1 else 1.0
    sizes = held.select("node", F.floor(F.log("size") / F.lit(border)).alias("k"), F.octet_length("words").cast("bigint").alias("bytes"))
    homes = F.array(F.struct("k", F.lit(False).alias("guest")), F.struct((F.col("k") + 1).alias("k"), F.lit(True).alias("guest")))
    placed = apart.join(sizes, "node").select("value", "node", "root", "bytes", F.explode(homes).alias("h")).select("value", "node", "root", "bytes", "h.k", "h.guest")
    # a group whose members are all guests or of one class has nothing to compare
    parts = placed.groupBy("value", "k", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.min("guest").alias("guest"))
    groups = parts.groupBy("value", "k").agg(
        F.max(F.struct("n", "bytes", "root")).alias("top"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"),
        F.count(F.lit(1)).alias("classes"), F.min("guest").alias("guests"),
    ).where("classes > 1 AND NOT guests")
    need = lambda n, size: F.greatest(F.ceil(n / F.lit(BLOCK)), F.ceil(size / F.lit(BLOCK_BYTES)), F.lit(1)).cast("bigint")
    groups = groups.select(
        "value", "k", F.col("top.root").alias("top"), need(F.col("top.n"), F.col("top.bytes")).alias("tops"),
        need(F.col("n") - F.col("top.n"), F.col("bytes") - F.col("top.bytes")).alias("rest"),
    )
    # the largest class has blocks 0 to tops - 1 and meets the others'; these meet all blocks, and their own pairs are compared with block 0
    met = placed.join(groups, ["value", "k"]).withColumn("first", F.when(F.col("root") == F.col("top"), F.lit(0)).otherwise(F.col("tops")).cast("bigint"))
    met = met.withColumn("own", F.col("first") + F.pmod(F.xxhash64("node"), F.when(F.col("first") == 0, F.col("tops")).otherwise(F.col("rest"))))
    from_, to = F.when(F.col("first") == 0, F.col("tops")).otherwise(F.lit(0)), F.col("tops") + F.col("rest") - 1
    others = F.filter(F.sequence(from_.cast("bigint"), to), lambda x: x != F.col("own"))
    dealt = met.withColumn("other", F.explode(others)).select(
        "value", "k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "root", "guest", "own",
        (F.col("other") == 0).alias("inside"),
    )
    keys = ["value", "k", "i", "j"]
    blocks = dealt.join(held, "node").repartition(*keys).sortWithinPartitions(*keys)
    rows = blocks.select(*keys, "node", "root", "guest", "own", "inside", "words", "values")
    return map_arrow(rows, _compare(threshold), "a bigint, b bigint")


def meet_before(value: int, values: list[list[int]]) -> np.ndarray:
    """Whether two members of the bucket ``value`` share one of a smaller value too, by the buckets of each."""
    at: dict[int, list[int]] = {}
    for i, own in enumerate(values):
        for v in own:
            if v < value:
                at.setdefault(v, []).append(i)
    out = np.zeros((len(values), len(values)), bool)
    for places in at.values():
        if len(places) > 1:
            out[np.ix_(places, places)] = True
    return out


def promising(score: np.ndarray, first: np.ndarray, second: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs between the classes ``first`` and ``second``: places of those that either class has among its ``keep``
    best, and whether one of their classes has more."""
    pair = np.tile(np.arange(len(score)), 2)
    of = np.concatenate([first, second])
    order = np.lexsort((pair, -score[pair], of))
    classes, starts, counts = np.unique(of[order], return_index=True, return_counts=True)
    place = np.arange(len(order)) - np.repeat(starts, counts)
    kept = np.unique(pair[order[place < keep]])
    more = classes[counts > keep]
    return kept, np.isin(first[kept], more) | np.isin(second[kept], more)


def links_of(score: np.ndarray, texts: list[np.ndarray], root: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Linked pairs of the members that can be similar (a score above minus infinity) until their classes are united.

    In each turn the classes name their most promising pairs. A pair is left out once its classes are one.
    """
    a, b = np.nonzero(score > -np.inf)
    best, out, keep = score[a, b], [], 1
    _, root = np.unique(root, return_inverse=True)
    while len(a):
        kept, _ = promising(best, root[a], root[b], keep)
        for p in kept[np.argsort(-best[kept], kind="stable")]:
            i, j = a[p], b[p]
            if root[i] != root[j] and similarity(texts[i], texts[j], threshold):
                out.append((int(i), int(j)))
                root = np.where(root == root[j], root[i], root)
        left = root[a] != root[b]
        left[kept] = False
        a, b, best, keep = a[left], b[left], best[left], keep * MORE
    return out


def _compare(threshold: float):
    def pairs_of(group: list[tuple]) -> tuple[list[int], list[int]]:
        node, root, own = (np.array([r[i] for r in group], np.int64) for i in (4, 5, 7))
        guest, inside = (np.array([r[i] for r in group]) for i in (6, 8))
        fit = (root[:, None] != root[None, :]) & ((own[:, None] != own[None, :]) | inside[:, None])
        fit &= ~(guest[:, None] & guest[None, :]) & (node[:, None] < node[None, :])
        if fit.any():
            fit &= ~meet_before(group[0][0], [r[10] for r in group])
        used = np.flatnonzero(fit.any(axis=0) | fit.any(axis=1))
        if not len(used):
            return [], []
        texts = [word_hashes(group[i][9]) for i in used]
        bound = reachable(np.array([len(t) for t in texts], np.int64), [word_pairs(t) for t in texts], threshold)
        score = np.where(fit[np.ix_(used, used)], bound, -np.inf)
        found = links_of(score, texts, root[used], threshold)
        return [int(node[used[i]]) for i, _ in found], [int(node[used[j]]) for _, j in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        group: list[tuple] = []
        out: dict[str, list] = {"a": [], "b": []}

        def close() -> None:
            for values, more in zip(out.values(), pairs_of(group)):
                values += more

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and row[:4] != group[0][:4]:
                    close()
                    group.clear()
                group.append(row)
            yield out
            out = {"a": [], "b": []}
        if group:
            close()
            yield out

    return run

"""Near-duplicate classes against all pairs."""

import random
import time
from collections import Counter

import numpy as np
import pytest

from noteforge.llm import neardup
from noteforge.llm.neardup import (
    connected,
    edit_distance,
    joined,
    labelled,
    near_duplicates,
    reachable,
    shingles,
    similarity,
    sketches,
    united,
    word_bytes,
    word_hashes,
)
from tests.llm.fixtures import DOCS, awkward, documents, words


def of(text):
    return word_hashes(word_bytes(text))


def distance(a, b):
    """Edit distance, the plain way."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def near(a, b):
    """Linked by the plain distance: 0.8 or more of the longer text's words stay."""
    x, y = a.split(), b.split()
    n = max(len(x), len(y))
    if 5 * abs(len(x) - len(y)) > n or 5 * (n - sum((Counter(x) & Counter(y)).values())) > n:
        return False  # no distance is less than what sizes or bags differ in
    return 5 * distance(x, y) <= n


def classes(rows):
    """Smallest id connected by links, over all pairs with an equal sketch; equal texts are linked always."""
    keys = sorted({i for i, _ in rows}, key=lambda i: (i is not None, i or 0))
    root = {k: k for k in keys}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    made = []
    for i, t in rows:
        w = word_bytes(t)
        made.append((i, w, set(sketches(labelled(shingles(word_hashes(w)))).tolist()) if w else set()))
    for n, (i, a, s) in enumerate(made):
        for j, b, t in made[:n]:
            if a and b and (a == b or (s & t and top(i) != top(j) and near(a, b))):
                x, y = sorted((top(i), top(j)), key=keys.index)
                root[y] = x
    return {k: top(k) for k in keys}


def changed(rng, text, share):
    """A copy with that share of its words replaced, dropped or doubled."""
    out = list(text)
    for at in sorted(rng.sample(range(len(out)), round(share * len(out))), reverse=True):
        kind = rng.random()
        if kind < 0.6:
            out[at] = f"new{rng.randrange(10**9)}"
        elif kind < 0.8:
            del out[at]
        else:
            out.insert(at, f"more{rng.randrange(10**9)}")
    return out


def test_distance_against_the_plain_one():
    rng = random.Random(5)
    for _ in range(600):
        letters = rng.choice([2, 4, 30])
        a = [rng.randrange(letters) for _ in range(rng.randint(1, 90))]
        b = list(a) if rng.random() < 0.8 else [rng.randrange(letters) for _ in range(rng.randint(1, 90))]
        for _ in range(rng.randint(0, 12)):
            at = rng.randrange(len(b))
            b[at : at + rng.randint(0, 1)] = [rng.randrange(letters)] * rng.randint(0, 2)
            b = b or [0]
        want = distance(a, b)
        x, y = np.array(a, np.uint64), np.array(b, np.uint64)
        for most in (0, 2, 7, 200):
            assert edit_distance(x, y, most) == min(want, most + 1)
        n = max(len(a), len(b))
        value = 1 - want / n
        assert abs(similarity(x, y) - value) < 1e-9 if 5 * want <= n else similarity(x, y) == 0


@pytest.mark.parametrize("narrow,many", [(1, 2), (3, 10**9)])
def test_widening_bands_and_both_kinds_of_places(monkeypatch, narrow, many):
    monkeypatch.setattr(neardup, "NARROW", narrow)
    monkeypatch.setattr(neardup, "MANY", many)
    rng = random.Random(6)
    for _ in range(200):
        a = [rng.randrange(6) for _ in range(70)]
        b = [int(x) if not isinstance(x, str) else 9 for x in changed(rng, a, 0.2)]
        want = distance(a, b)
        assert edit_distance(np.array(a, np.uint64), np.array(b, np.uint64), 60) == min(want, 61)


def test_long_repetitive_texts_take_no_square_of_time():
    a = np.arange(20_000, dtype=np.uint64) % 2
    b = a.copy()
    b[::17] = 7
    began = time.time()
    assert similarity(a, b) == pytest.approx(1 - len(b[::17]) / 20_000)
    assert time.time() - began < 5


def test_block_bound_never_hides_a_link():
    rng = random.Random(7)
    base = [words(rng, rng.choice([30, 60, 300])) for _ in range(12)]
    texts = [" ".join(t) for b in base for t in [b, changed(rng, b, 0.1), changed(rng, b, 0.19), b[: len(b) // 2]]] + ["one", "", "two words"]
    hashes = [word_hashes(word_bytes(t)) for t in texts]
    grams = [(shingles(h, 2) >> np.uint64(48)).astype(np.uint16).tobytes() if len(h) > 1 else None for h in hashes]
    grams[5] = None  # as of a very long text
    fit = reachable(np.array([len(h) for h in hashes]), grams, 0.8) > -np.inf
    for i, a in enumerate(hashes):
        for j, b in enumerate(hashes):
            assert fit[i, j] or not similarity(a, b)
    assert fit[:48, :48].mean() < 0.2


@pytest.mark.parametrize("share", [0.02, 0.05, 0.1])
def test_recall_of_edited_copies(spark, share):
    """Pairs at an edit similarity of 0.9 or more, by the plain distance: nine of ten are linked at least."""
    rng = random.Random(int(share * 100))
    rows = []
    for i in range(60):
        text = words(rng, rng.choice([120, 300, 600]))
        rows += [(i, " ".join(text)), (1000 + i, " ".join(changed(rng, text, share)))]
    texts = dict(rows)
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(documents(spark, rows)).collect()}
    true = [i for i in range(60) if near(word_bytes(texts[i]), word_bytes(texts[1000 + i]))]
    assert len(true) >= 58
    assert sum(got[i] == got[1000 + i] for i in true) >= 0.9 * len(true)
    assert len({got[i] for i in range(60)}) == 60


def test_classes_of_awkward_rows(spark):
    rows = awkward()
    got = near_duplicates(documents(spark, rows)).collect()
    want = classes(rows)
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["class_id"]) for r in got} == {(i, want[i]) for i, _ in rows}


def test_classes_of_a_table_and_a_large_group(spark, sf):
    rng = random.Random(8)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    base = words(rng, 200)
    for i in range(60):
        own = list(base)
        own[rng.randrange(200)] = f"new{i}"
        rows.append((10_000 + i, " ".join(own)))
    got = near_duplicates(documents(spark, rows)).collect()
    want = classes(rows)
    assert {r["doc_id"]: r["class_id"] for r in got} == want
    assert {want[10_000 + i] for i in range(60)} == {10_000}


def star(rng, n, size=300, share=0.12):
    """Copies that are near one original, which has the largest id, and seldom near each other."""
    base = words(rng, size)
    rows = []
    for i in range(n):
        own = list(base)
        for at in rng.sample(range(size), int(size * share)):
            own[at] = f"new{i}x{at}"
        rows.append((i, " ".join(own)))
    return [*rows, (n, " ".join(base))]


def test_star_shaped_groups(spark):
    rows = star(random.Random(2), 80)
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(documents(spark, rows)).collect()}
    assert got == classes(rows)
    assert sum(c == got[80] for c in got.values()) > 60


def test_buckets_of_unlike_texts(spark, monkeypatch):
    """Pairs that share buckets with many unlike texts, each linked to its partner only, over many blocks."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(6)
    common, rows = words(rng, 120), []
    for i in range(60):
        own = common + words(rng, 60)
        rows += [(i, " ".join(own)), (100 + i, " ".join(own[:-1] + ["end"]))]
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(documents(spark, rows)).collect()}
    assert got == classes(rows)


def test_sizes_on_both_sides_of_a_border(spark):
    rng = random.Random(9)
    rows = []
    for i, n in enumerate(range(40, 120, 2)):
        text = words(rng, n)
        rows += [(i, " ".join(text)), (1000 + i, " ".join(text[: n - int(0.19 * n)]))]
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(documents(spark, rows)).collect()}
    assert got == classes(rows) and sum(got[1000 + i] == i for i in range(40)) >= 38


def test_clashing_columns_and_scratch(spark):
    docs = documents(spark, awkward())
    wide = docs.selectExpr("*", "1 AS id", "2 AS node", "3 AS value", "'x' AS words", "4 AS class_id")
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["class_id"] or 0)
    assert sorted(near_duplicates(wide).collect(), key=key) == sorted(near_duplicates(docs).collect(), key=key)


def test_labels_tell_repeats_apart():
    h = labelled(np.array([5, 7, 5, 5, 7], np.uint64))
    assert len(set(h.tolist())) == 5 and h[0] == 5 and h[1] == 7


def test_connected(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (5, 6), (4, 4), *[(i, i + 1) for i in range(100, 160)]]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {2: 1, 3: 1, 8: 7, 9: 7, 6: 5} | {i: 100 for i in range(101, 161)}


def components(edges):
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    return {x: top(x) for x in root}


def test_classes_of_centres_and_members(spark):
    """Random links of centres and members, then links between their classes, against plain union."""
    rng = random.Random(11)
    first = [(rng.randrange(40), rng.randrange(300)) for _ in range(150)] + [(400, 3), (5, 400), (350, 351)]
    first = [(a, b) for a, b in first if a != b]
    more = [(rng.randrange(300), rng.randrange(500, 520)) for _ in range(10)] + [(600, 601), (601, 602), (351, 2)]
    work = neardup.Workspace(spark, "test")
    root = united(spark.createDataFrame(first, "a bigint, b bigint").distinct(), work)
    assert {r["node"]: r["root"] for r in root.collect()} == components(first)
    both = joined(root, spark.createDataFrame(more, "a bigint, b bigint"), work)
    want = components(first + more)
    got = {r["node"]: r["root"] for r in both.collect()}
    assert {x: got.get(x, x) for x in want} == want


def test_classes_name_their_best_pairs():
    score = np.array([0.9, 0.5, 0.7, 0.1])
    first, second = np.array([1, 1, 2, 3]), np.array([2, 3, 3, 4])
    kept, cut = neardup.promising(score, first, second, 1)
    assert kept.tolist() == [0, 2, 3] and cut.tolist() == [True, True, True]
    kept, cut = neardup.promising(score, first, second, 3)
    assert kept.tolist() == [0, 1, 2, 3] and not cut.any()


def test_border_copies_are_compared_in_one_pass(spark, monkeypatch):
    """Copies at the border of the threshold stay in several classes; their buckets are gone over once."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    passes, within = [], neardup._within
    monkeypatch.setattr(neardup, "_within", lambda *a: passes.append(a[0].count()) or within(*a))
    rng = random.Random(12)
    rows = [*star(rng, 60, 100, 0.1), *[(100 + i, t) for i, t in star(rng, 60, 100, 0.21)]]
    base = rows[60][1].split()
    rows += [(200 + i, " ".join(w if k % 5 else f"far{i}x{k}" for k, w in enumerate(base))) for i in range(5)]
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(documents(spark, rows)).collect()}
    assert got == classes(rows) and len(set(got.values())) > 20
    assert len(passes) == 1 and passes[0] > 20


def test_largest_class_of_a_bucket_is_dealt_once(spark, monkeypatch):
    """A bucket of one large class and a few others: rows grow with its members, not with their square."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    dealt = []
    monkeypatch.setattr(neardup, "map_arrow", lambda rows, *_: dealt.append(rows) or rows)
    held = [(i, b" ".join(b"w%d" % k for k in range(50)), 50, [7]) for i in range(200)]
    held = spark.createDataFrame(held, "node bigint, words binary, size bigint, values array<bigint>")
    apart = held.selectExpr("7L AS value", "node", "IF(node < 197, 0L, node) AS root")
    neardup._within(apart, held, 0.8)
    rows = dealt[0].collect()
    assert len(rows) < 400
    cells = {}
    for r in rows:
        cells.setdefault((r["value"], r["k"], r["i"], r["j"]), []).append(r)
    met = [tuple(sorted((x["node"], y["node"]))) for c in cells.values() for x in c for y in c
           if x["node"] < y["node"] and x["root"] != y["root"] and (x["own"] != y["own"] or x["inside"])]
    assert sorted(met) == [(i, j) for i in range(200) for j in range(max(i + 1, 197), 200)]


def test_links_leave_out_what_is_one_class():
    texts = [of("a b c d e f g h i j"), of("a b c d e f g h i x"), of("a b c d e f g h y j"), of("k l m n o p q r s t")]
    score = np.triu(np.full((4, 4), 0.5), 1)
    score[score == 0] = -np.inf
    found = neardup.links_of(score, texts, np.array([5, 6, 7, 8]), 0.8)
    assert len(found) == 2 and components(found) == {0: 0, 1: 0, 2: 0}
    assert neardup.links_of(score, texts, np.array([5, 5, 5, 8]), 0.8) == []


def test_pairs_meet_in_their_first_bucket():
    got = neardup.meet_before(5, [[9, 5, 1], [1, 5], [5, 3, -2], [5, -2, 9]])
    want = np.zeros((4, 4), bool)
    want[0, 1] = want[1, 0] = want[2, 3] = want[3, 2] = True
    assert (got | np.eye(4, dtype=bool) == want | np.eye(4, dtype=bool)).all()


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], DOCS)).collect() == []

"""Product codes: trees, exact assignment, brute-force rounds and defined results."""

import math
import random

import numpy as np
import pytest

from noteforge.llm.codes import assign, books_digest, cover_tree, squares, vector_codes, with_label_errors

TABLE = "vec_id bigint, embedding array<double>, label string"


def brute(rows, parts, entries, rounds, scale):
    """``{(id, place among its rows): (code, error, label)}`` and codebooks, in Python's integers."""
    fit = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max((len(v) for _, v, _ in fit), default=0) // parts))
    ints = [[math.floor(x * scale) for x in v] + [0] * (width * parts - len(v)) for _, v, _ in fit]
    first = sorted(range(len(fit)), key=lambda r: (fit[r][0] is None, fit[r][0] or 0, ints[r]))[:entries]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(ints[r], p) for r in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, book: min((far(v, e), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            own = [near(cut(v, p), book)[1] for v in ints]
            for e in range(len(book)):
                mine = [cut(v, p) for v, o in zip(ints, own) if o == e]
                if mine:
                    book[e] = [sum(c) // len(mine) for c in zip(*mine)]
    out = []
    for (i, _, lab), v in zip(fit, ints):
        found = [near(cut(v, p), book) for p, book in enumerate(books)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), min(sum(d for d, _ in found), (1 << 63) - 1), lab))
    return out, [np.array(b, object).reshape(len(b), width) for b in books]


def check(spark, rows, parts=4, entries=5, rounds=2, scale=16):
    frame = spark.createDataFrame(rows, TABLE).repartition(3)
    coded, books = vector_codes(frame, parts=parts, entries=entries, rounds=rounds, scale=scale)
    want, want_books = brute(rows, parts, entries, rounds, scale)
    got = with_label_errors(coded).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r["id"], r["code"], r["error"], r["label"]) for r in got), key=key) == sorted(want, key=key)
    assert books_digest(books) == books_digest(want_books)
    sums = {}
    for _, _, error, lab in want:
        sums[lab] = sums.get(lab, 0) + error
    assert all(r["label_error"] == min(sums[r["label"]], (1 << 63) - 1) for r in got)


@pytest.mark.parametrize("spread", [0.2, 3.0])
def test_against_brute_force(spark, spread):
    rng = random.Random(5)
    centres = [[rng.uniform(-8, 8) for _ in range(8)] for _ in range(6)]
    rows = [(i, [rng.gauss(x, spread) for x in rng.choice(centres)], rng.choice(["a", "b", None])) for i in range(900)]
    check(spark, rows)


def test_defined_results(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 2.0, 3.0, 4.0], "a"), (1, [1.0, 2.0, 3.0, 4.0], "a"), (1, [0.0, 9.0], None), (None, [5.0] * 5, "b"), (2, None, "a"),
        (3, [1.0, None], "a"), (4, [nan], "a"), (5, [inf, 1.0], "b"), (6, [], "b"), (7, [-0.01, -0.0, 0.01], ""), (8, [2.5] * 4, None),
    ]
    check(spark, rows)
    check(spark, rows, entries=2, rounds=0)
    assert with_label_errors(vector_codes(spark.createDataFrame([], TABLE))[0]).collect() == []


def test_ties_and_equal_points(spark):
    check(spark, [(i, [float(i % 2)] * 4, None) for i in range(200)], entries=4)
    check(spark, [(i, [1.0, 1.0], "x") for i in range(100)], entries=3)


def test_large_components_stay_exact(spark):
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-1, 1) * 2.0 ** rng.choice([3, 40, 70]) for _ in range(4)], "a") for i in range(40)]
    check(spark, rows)


def test_extra_columns_are_ignored(spark):
    rows = [(i, [float(i), 1.0, 2.0, 3.0], "a") for i in range(20)]
    plain = spark.createDataFrame(rows, TABLE)
    wide = plain.selectExpr("*", "1 AS id", "'x' AS code", "2 AS error", "3 AS v", "4 AS _l")
    assert sorted(vector_codes(plain)[0].collect()) == sorted(vector_codes(wide)[0].collect())


def test_tree_covers_and_separates():
    points = np.random.default_rng(3).integers(-50, 50, (700, 3)).astype(np.float64)
    tree = cover_tree(points, leaf=8)
    assert sorted(tree.order) == list(range(700))
    for (start, end, centre, first, children), radius in zip(tree.nodes, tree.radii):
        own = points[tree.order[start:end]]
        assert np.sqrt(((own - points[centre]) ** 2).sum(axis=1)).max() <= radius
        if children:
            kids = tree.nodes[first : first + children]
            assert kids[0][0] == start and kids[-1][1] == end and (kids[1:, 0] == kids[:-1, 1]).all()
            heads = points[kids[:, 2]]
            apart = np.sqrt(squares(heads, heads)) + np.where(np.eye(children), np.inf, 0)
            assert apart.min() > radius / 2 * (1 - 1e-6)


def test_whole_subtrees_are_assigned():
    rng = np.random.default_rng(4)
    entries = rng.integers(-1000, 1000, (8, 2)).astype(np.float64)
    points = np.concatenate([e + rng.integers(-5, 6, (300, 2)) for e in entries])
    whole, single, _ = assign(cover_tree(points), points, entries)
    assert len(single) < 100 and sum(e - s for s, e, _ in whole) > 2300

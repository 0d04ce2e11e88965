"""Phrases of any length against a plain search."""

import random

import pytest

from noteforge.operators import phrases as H

NOTES = "id string, tokens array<string>"


def plain(notes, phrases):
    out = []
    for key, tokens in notes:
        for i in range(len(tokens or [])):
            for p in set(phrases) - {None, ""}:
                n = len(p.split(" "))
                if tokens[i : i + n] == p.split(" "):
                    out.append((key, i + 1, n, p))
    return sorted(out, key=repr)


def cases():
    rng = random.Random(4)
    letters = "abcd"
    notes = [(f"n{i}", [rng.choice(letters) for _ in range(rng.randint(0, 60))]) for i in range(40)]
    notes += [("null", None), ("empty", []), (None, ["a", "b", "a"]), ("twice", ["a", "b"]), ("twice", ["a", "b"]), ("gap", ["a", None, "b", "c"])]
    phrases = {" ".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(150)}
    phrases |= {"a " + " ".join(rng.choice(letters) for _ in range(5)) for _ in range(100)}  # a first word with most phrases
    return notes, sorted(phrases) + [None, "", "x y", "a b c d a b c d a b c d"]


@pytest.mark.parametrize("part_nodes", [H.PART_NODES, 200])
def test_all_places_of_all_phrases(spark, part_nodes):
    notes, phrases = cases()
    table = spark.createDataFrame([(p,) for p in phrases + phrases], "phrase string")
    assert (len(H.tries(table, part_nodes)) > 1) == (part_nodes == 200)
    got = H.find_phrases(spark.createDataFrame(notes, NOTES).repartition(3), "id", table, part_nodes=part_nodes).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(notes, phrases)


def test_senses_of_hits(spark):
    notes = spark.createDataFrame([("n", "the acute heart failure of heart".split())], NOTES)
    dictionary = spark.createDataFrame([("heart", "C1", 5), ("heart", "C2", 3), ("acute heart failure", "C3", 1), (None, "C4", 1)], "phrase string, cui string, freq bigint")
    got = {(r["start"], r["words"], r["cui"], r["freq"]) for r in H.match_phrases(notes, "id", dictionary).collect()}
    assert got == {(2, 3, "C3", 1), (3, 1, "C1", 5), (3, 1, "C2", 3), (6, 1, "C1", 5), (6, 1, "C2", 3)}


def test_empty_sides(spark):
    notes = spark.createDataFrame([("n", ["a"])], NOTES)
    none = spark.createDataFrame([], "phrase string")
    assert H.find_phrases(notes, "id", none).collect() == []
    assert H.find_phrases(notes.limit(0), "id", spark.createDataFrame([("a",)], "phrase string")).collect() == []

import datetime

import pytest

from noteforge import fixed
from noteforge.plans import jobs
from noteforge.sources import readers, writers


def test_tsv_round_trip(spark, tmp_path):
    rows = [("a", 'say "hi"\tthere', ["S1", "S2"]), ("b", "é", [])]
    df = spark.createDataFrame(rows, "fname string, bow string, snomed array<string>")
    writers.write_tsv(df, str(tmp_path / "t"))
    back = readers.read_notes(spark, str(tmp_path / "t"), "fname string, bow string, snomed string").orderBy("fname")
    assert [tuple(r)[:2] for r in back.collect()] == [("a", 'say "hi"\tthere'), ("b", "é")]
    assert back.first()["snomed"] == "S1 S2"


def test_named_table(spark, tmp_path):
    line = "n1\te\t2001-02-03\tauth\tN\tN\tL\tF\t7\tCardiology\tF\t61\t1\tu\tr\tlab\n"
    (tmp_path / "meta.txt").write_text(line)
    r = readers.read_named(spark, str(tmp_path / "meta.txt")).first()
    assert (r["fname"], r["date"], r["age"], r["sp"], r["label"]) == ("n1", datetime.date(2001, 2, 3), 61, 1, "lab")
    assert len(r) == 16


def test_labels_and_latin1(spark, tmp_path):
    (tmp_path / "l.txt").write_text("n1\tx\nn2\ty\n")
    assert [tuple(r) for r in readers.read_labels(spark, str(tmp_path / "l.txt")).orderBy("fname").collect()] == [("n1", "x"), ("n2", "y")]
    (tmp_path / "d.txt").write_bytes("fname\tbow\nn1\tcafé\n".encode("latin-1"))
    assert tuple(readers.read_latin1(spark, str(tmp_path / "d.txt"), fixed.TEXT_NOTES_DDL).first()) == ("n1", "café")


def test_concept_lines(spark, tmp_path):
    (tmp_path / "a.res").write_text("00000000|MMI|3.5|Heart|C0018787|[bpoc,x]|more\nnoise\n00000000|MMI|bad\n")
    rows = readers.read_concept_lines(spark, str(tmp_path)).orderBy("score").collect()
    assert [(r["fname"], r["score"], r["cui"]) for r in rows] == [("a.res", None, None), ("a.res", 3.5, "C0018787")]
    assert rows[1]["semtypes"] == ["bpoc", "x"]


def test_word_vectors(spark, tmp_path):
    (tmp_path / "v.vec").write_text("2 3\ncat 1 2 3\ndog 0.5 -1 2e-1\n")
    got = {r["word"]: r["vec"] for r in readers.read_word_vectors(spark, str(tmp_path / "v.vec"), 3).collect()}
    assert set(got) == {"cat", "dog"} and got["cat"] == [1.0, 2.0, 3.0]
    assert got["dog"] == pytest.approx([0.5, -1.0, 0.2])


def test_names():
    assert writers.feature_of("/x/model-f=sg_st-a=l2") == "sg_st"
    assert writers.run_name("freq", "l1+nb", "None", "bow", 1, 5) == "freq_l1+nb_None_bow_1_5"
    with pytest.raises(ValueError):
        writers.feature_of("/x/other")


def test_cohort(spark, tmp_path):
    meta = [("n1", "A", "x", 1), ("n2", "A", "y", 0), ("n3", "B", "x", 1), ("n4", "C", "x", 1), ("n5", "B", "y", 1), ("n6", "A", "x", 1)]
    meta = spark.createDataFrame(meta, "fname string, spDesc string, author string, sp int")
    notes = spark.createDataFrame([(f"n{i}", f"text {i}") for i in range(1, 8)], fixed.TEXT_NOTES_DDL)
    data, labels, stats = jobs.build_cohort(notes, meta, "sp", 2, path=str(tmp_path / "c"))
    assert {r["fname"] for r in data.collect()} == {"n1", "n3", "n5", "n6"}
    assert {tuple(r) for r in labels.collect()} == {("n1", "A"), ("n3", "B"), ("n5", "B"), ("n6", "A")}
    assert tuple(stats.first()) == (2, 4)
    back = readers.read_labels(spark, str(tmp_path / "c" / "label"))
    assert back.count() == 4
    _, labels, _ = jobs.build_cohort(notes, meta, "exp", 2)
    assert {r["label"] for r in labels.collect()} == {"x"}
    with pytest.raises(ValueError):
        jobs.build_cohort(notes, meta, "other", 1)


def test_output_order(spark):
    df = spark.createDataFrame([("b",), ("a",)], "fname string")
    assert [r[0] for r in writers.sorted_for_output(df, "fname").collect()] == ["a", "b"]


def test_tsv_keeps_line_breaks_backslashes_and_empty_texts(spark, tmp_path):
    rows = [("a", "one\ntwo\r\nthree"), ("b", ""), ("c", None), ("d", "back\\nslash \\\\ \"quoted\"\ttab\\")]
    writers.write_tsv(spark.createDataFrame(rows, "fname string, bow string"), str(tmp_path / "t"))
    back = readers.read_notes(spark, str(tmp_path / "t"), "fname string, bow string").orderBy("fname")
    assert [tuple(r) for r in back.collect()] == rows

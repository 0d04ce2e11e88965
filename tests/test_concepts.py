import pytest
from pyspark.sql import functions as F

from noteforge import fixed
from noteforge.functions.text import tokens_ws
from noteforge.operators import concepts as C
from noteforge.plans import jobs
from noteforge.sources import readers

SCHEMA = "doc_id long, text string, concepts array<struct<cui:string,tui:string,code:string,scheme:string>>"
ROWS = [
    (1, "many", [("C2", "T047", "22", "SNOMEDCT"), ("C1", "T121", "11", "RXNORM"), ("C1", "T121", "11", "RXNORM"),
                 ("C3", "T046", "33", "ICD10"), ("C4", "T999", "44", "SNOMEDCT")]),
    (2, "none", []),
    (3, "null", None),
]


def test_code_sets(spark):
    got = {r["doc_id"]: r for r in C.note_columns(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    one = got[1]
    assert (one["snomed"], one["umls"], one["sg"], one["st"]) == ("S22 S44", "C1 C2 C3 C4", "C1 C2 C3", "C1 C2")
    for i in (2, 3):
        assert [got[i][c] for c in ("snomed", "umls", "sg", "st")] == [fixed.NO_ANNOTATION] * 4
        assert got[i]["text"] == ROWS[i - 1][1]


def test_concept_rows_prefix(spark):
    got = {(r["cui"], r["code"]) for r in C.concept_rows(spark.createDataFrame(ROWS, SCHEMA), "doc_id").collect()}
    assert got == {("C2", "S22"), ("C1", "R11"), ("C3", "33"), ("C4", "S44")}


DICT = [
    ("heart", "C1", "T023", "1", "SNOMEDCT", 10), ("heart failure", "C2", "T047", "2", "SNOMEDCT", 3),
    ("failure", "C3", "T033", "3", "RXNORM", 5), ("failure", "C4", "T033", "4", "RXNORM", 9),
    ("failure", "C5", "T033", "5", "RXNORM", 9),
]


@pytest.fixture(scope="module")
def matches(spark):
    notes = spark.createDataFrame([(1, "heart failure heart"), (2, "nothing"), (3, "")], "doc_id long, text string")
    notes = notes.select("doc_id", "text", tokens_ws("text").alias("tokens"))
    dictionary = spark.createDataFrame(DICT, "phrase string, cui string, tui string, code string, scheme string, freq long")
    return notes, C.concept_match(notes, "doc_id", dictionary)


def test_match_prune_best(matches):
    notes, found = matches
    assert {(r["start"], r["words"], r["cui"]) for r in found.collect()} == {
        (1, 1, "C1"), (1, 2, "C2"), (2, 1, "C3"), (2, 1, "C4"), (2, 1, "C5"), (3, 1, "C1")
    }
    pruned = C.concept_prune(found, "doc_id", threshold=0.3, keep=2)
    assert {(r["start"], r["cui"]) for r in pruned.collect()} == {(1, "C2"), (1, "C1"), (2, "C3"), (2, "C4"), (3, "C1")}
    assert C.concept_prune(found, "doc_id", threshold=0.5).count() == 1
    best = C.concept_best(found, "doc_id")
    assert {(r["start"], r["cui"]) for r in best.collect()} == {(1, "C2"), (2, "C4"), (3, "C1")}
    noted = {r["doc_id"]: len(r["concepts"]) for r in C.annotate(notes, best, "doc_id").collect()}
    assert noted == {1: 3, 2: 0, 3: 0}


XML = '<?xml version="1.0" encoding="UTF-8"?><CAS version="2"><uima.cas.Sofa _id="1" sofaString="{text}"/>{concepts}</CAS>'
ITEM = '<org.apache.ctakes.typesystem.type.refsem.UmlsConcept codingScheme="{2}" code="{1}" cui="{0}" tui="T047"/>'


def test_convert_xml_and_text(spark, tmp_path):
    folder = tmp_path / "xml"
    folder.mkdir()
    cases = {"many.xml": [("C1", "1", "SNOMEDCT"), ("C2", "2", "ZZZ")], "one.xml": [("C1", "1", "RXNORM")], "none.xml": []}
    for name, items in cases.items():
        body = "".join(ITEM.format(*i) for i in items)
        (folder / name).write_text(XML.format(text="Big&#10;Heart &amp; <br />".replace("<br />", "&lt;br />"), concepts=body))
    (folder / "skip.txt").write_text("no")
    got = {r["fname"]: r for r in jobs.convert(spark, str(folder), "xml").collect()}
    assert set(got) == set(cases)
    assert {r["bow"] for r in got.values()} == {"big heart & "}
    assert (got["many.xml"]["snomed"], got["many.xml"]["umls"]) == ("S1", "C1 C2")
    assert (got["one.xml"]["umls"], got["one.xml"]["snomed"]) == ("C1", "")
    assert got["none.xml"]["umls"] == "N"

    text = tmp_path / "txt"
    text.mkdir()
    (text / "a.txt").write_text("Line1\nLine2")
    (text / "b.res").write_text("Other")
    assert [tuple(r) for r in jobs.convert(spark, str(text), "txt", str(tmp_path / "out")).collect()] == [("a.txt", "line1 line2")]
    back = readers.read_notes(spark, str(tmp_path / "out"), fixed.TEXT_NOTES_DDL)
    assert [tuple(r) for r in back.collect()] == [("a.txt", "line1 line2")]
    assert jobs.convert(spark, str(text), "res").first()["fname"] == "b.res"
    with pytest.raises(ValueError):
        jobs.convert(spark, str(text), "cas")


def test_xml_round_trip(spark):
    df = spark.createDataFrame(ROWS[:2], SCHEMA)
    back = readers.parse_annotation_xml(readers.to_annotation_xml(df), "xml")
    assert sorted(map(tuple, back.select(*df.columns).collect())) == sorted(map(tuple, df.collect()))


def test_groups(spark):
    df = spark.createDataFrame([("T047",), ("T046",), ("T999",)], "tui string")
    got = [tuple(r) for r in df.select("tui", C.in_group(F.col("tui")), C.in_type(F.col("tui"))).collect()]
    assert got == [("T047", True, True), ("T046", True, False), ("T999", False, False)]


def test_convert_masks_and_annotates_raw_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Heart failure since May, mail me@host.org")
    (tmp_path / "b.txt").write_text("nothing here")
    senses = [("heart failure", "C1", "T047", "10", "SNOMEDCT"), ("failure", "C2", "T033", "11", "SNOMEDCT")]
    dictionary = spark.createDataFrame(senses, "phrase string, cui string, tui string, code string, scheme string")
    got = {r["fname"]: r for r in jobs.convert(spark, str(tmp_path), "txt", deidentify=True, dictionary=dictionary).collect()}
    assert got["a.txt"]["umls"] == "C1" and got["a.txt"]["snomed"] == "S10"
    assert "host.org" not in got["a.txt"]["bow"]
    assert got["b.txt"]["umls"] == "N"

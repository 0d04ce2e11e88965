import pytest
from pyspark.sql import functions as F

from noteforge import fixed
from noteforge.functions import arrays as A
from noteforge.functions import text as X
from noteforge.functions.stem import stem_words
from noteforge.operators import tokens as T


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t"))).first()[0]


def test_stop_words_are_the_ones_spark_loads(spark):
    from pyspark.ml.feature import StopWordsRemover

    assert fixed.STOP_WORDS == StopWordsRemover.loadDefaultStopWords("english")
    assert len(fixed.SEMANTIC_GROUP_TUIS) == len(set(fixed.SEMANTIC_GROUP_TUIS)) == 56
    assert len(set(fixed.SEMANTIC_TYPE_TUIS)) == 15


def test_clean_note(spark):
    raw = f"{fixed.RECORD_START}A\tB\r\n<br /><P>c</p>{fixed.RECORD_END}"
    assert one(spark, raw, X.clean_note) == "a b <p>c"
    assert one(spark, None, X.clean_note) is None


@pytest.mark.parametrize("raw,want", [("a\nb\nc\nd", "c\nd"), ("a\nb", ""), ("a", ""), ("", "")])
def test_trim_header(spark, raw, want):
    assert one(spark, raw, X.trim_header) == want


def test_trim_header_lines(spark):
    assert one(spark, "a\nb\nc", lambda c: X.trim_header(c, 1)) == "b\nc"


def test_deidentify(spark):
    raw = "mail a.b@c.org or +1 (743) 555-3824 from 10.0.0.1 on 2001-02-03, card 4111 1111 1111 1111, ssn 123-45-6789"
    masked = one(spark, raw, X.deidentify)
    assert masked == (
        "mail [**EMAIL**] or [**PHONE**] from [**IP**] on [**DATE**], card [**CARD**], ssn [**SSN**]"
    )
    assert one(spark, masked, X.deidentify) == masked
    assert one(spark, "x [**A**] keep [**B c**] y", X.strip_placeholders) == "x  keep  y"


def test_phi_report(spark):
    df = spark.createDataFrame([(1, "a@b.org c@d.org"), (2, "e@f.org 1.2.3.4"), (3, "none")], "id long, text string")
    got = {r["kind"]: (r["findings"], r["notes"]) for r in T.phi_report(df, "id").collect()}
    assert got == {"EMAIL": (3, 2), "IP": (1, 1)}


def test_html_text(spark):
    raw = "x &amp;lt; &#233;&#x41; &copy; &bogus; &#38;lt;<b>hi</b><script>v='</p>'</script><!-- <i> -->z<br>w"
    assert one(spark, raw, X.html_text) == "x &lt; éA © &bogus; &lt;hizw"
    assert one(spark, "<li>a</li><li>b</li>", lambda c: X.html_text(c, " ")) == " a  b "
    assert one(spark, "&#99999999999; &#xD800;", X.html_text) == "&#99999999999; &#xD800;"


def test_normalisers(spark):
    assert one(spark, "Café\r\nNo_1!", X.norm_alnum) == "caf  no_1 "
    assert one(spark, "The Cat's 2 dogs,  and é", X.norm_text) == "cats dogs é"


def test_tokens(spark):
    assert one(spark, "The 2nd étude, a .5 x_y foo-bar the", X.tokenize) == ["the", "étude", "x_y", "foo", "bar", "the"]
    assert one(spark, "", X.tokenize) == []
    assert one(spark, " A  b\n", X.tokens_ws) == ["a", "b"]
    assert one(spark, "the cat the cat", lambda c: X.drop_stop_words(X.tokens_ws(c))) == ["cat", "cat"]


def test_switchable_chain(spark):
    prose = X.tokenization(stop_words=fixed.STOP_WORDS, stem=F.upper)
    assert one(spark, "<p>The Cat</p>", prose) == ["CAT"]
    assert one(spark, "C01 <p> C02", X.tokenization(concept=True)) == ["C01", "<p>", "C02"]


def test_sentences_and_lines(spark):
    assert one(spark, "One. Two!  Three?\nFour 1.5 five", X.sentences) == ["One.", "Two!", "Three?", "Four 1.5 five"]
    rows = one(spark, "A,b\r\n\r\nC", X.clean_lines)
    assert [(r.line_no, r.line) for r in rows] == [(0, "a b"), (2, "c")]


def test_names(spark):
    assert one(spark, "Heart failure (12).xml", X.label_from_name) == "Heart failure"
    assert one(spark, "note.txt", X.label_from_name) == "note.txt"


STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "cats": "cat", "feed": "feed", "agreed": "agre",
    "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl",
    "sized": "size", "hopping": "hop", "falling": "fall", "hissing": "hiss", "filing": "file", "happy": "happi",
    "sky": "sky", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam", "operator": "oper",
    "hopefulness": "hope", "formaliti": "formal", "sensibiliti": "sensibl", "triplicate": "triplic",
    "electrical": "electr", "goodness": "good", "revival": "reviv", "airliner": "airlin", "replacement": "replac",
    "adoption": "adopt", "effective": "effect", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate",
    "cease": "ceas", "controll": "control", "roll": "roll", "is": "is",
}


def test_stems(spark):
    df = spark.createDataFrame([(w,) for w in STEMS], "w string")
    assert {r["w"]: r["stem"] for r in stem_words(df, "w").collect()} == STEMS


def test_stemmed_notes_keep_order_and_empty_notes(spark):
    df = spark.createDataFrame([(1, ["cats", "ponies", "cats"]), (2, [])], "id long, tokens array<string>")
    got = {r["id"]: r["tokens"] for r in T.stemmed(df, "id").collect()}
    assert got == {1: ["cat", "poni", "cat"], 2: []}


def test_padding(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([],), ([1, 2, 3, 4, 5],)], "ids array<bigint>")
    got = df.select(A.pad_right("ids", 4), A.pad_left("ids", 4)).collect()
    assert [tuple(r) for r in got] == [
        ([1, 2, 3, 0], [0, 1, 2, 3]), ([0, 0, 0, 0], [0, 0, 0, 0]), ([1, 2, 3, 4], [2, 3, 4, 5])
    ]


def test_ids_round_trip(spark):
    notes = spark.createDataFrame([(1, ["b", "a", "b"]), (2, ["c"]), (3, [])], "id long, tokens array<string>")
    vocab = T.vocabulary(T.words_of(notes), 3)
    assert {(r["word"], r["id"]) for r in vocab.collect()} == {("RARE", 0), ("b", 1), ("a", 2)}
    ids = T.to_ids(notes, "id", vocab)
    assert {r["id"]: r["ids"] for r in ids.collect()} == {1: [1, 2, 1], 2: [0], 3: []}
    words = {r["id"]: r["words"] for r in T.to_words(ids, "id", vocab).collect()}
    assert words == {1: ["b", "a", "b"], 2: ["RARE"]}

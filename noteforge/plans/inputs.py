"""Frames several registered queries start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteforge.functions import text as X
from noteforge.functions.arrays import argmax
from noteforge.operators import concepts as C
from noteforge.operators import tokens as T
from noteforge.operators.ranking import top_ranked
from noteforge.plans.sqltext import CUES
from noteforge.runtime import stage
from noteforge.sources.readers import table


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents", "doc_id")


def content(text: Column) -> Column:
    return X.drop_stop_words(X.tokenize(text))


def doc_tokens(spark: SparkSession, sf: str, stop: bool = True) -> DataFrame:
    """``(doc_id, tokens)`` hashed by document; stop words dropped unless ``stop`` is false."""
    return T.tokenized(table(spark, sf, "documents"), "doc_id", "text", content if stop else X.tokenize)


def corpus_tokens(spark: SparkSession, sf: str, stop: bool = True) -> DataFrame:
    """The same rows for corpus-wide counts: not moved."""
    return T.tokenized(documents(spark, sf), "doc_id", "text", content if stop else X.tokenize, hashed=False)


def corpus_words(spark: SparkSession, sf: str) -> DataFrame:
    return T.text_words(documents(spark, sf))


def doc_counts(spark: SparkSession, sf: str) -> DataFrame:
    """``(doc_id, word, n)`` hashed by document, stop words dropped."""
    return T.text_counts(table(spark, sf, "documents"), "doc_id")


def labelled_tokens(spark: SparkSession, sf: str, hashed: bool = True) -> DataFrame:
    docs = table(spark, sf, "documents") if hashed else documents(spark, sf)
    return T.tokenized(docs, "doc_id", "text", content, hashed, keep=("lang",))


# --- a concept dictionary derived from the corpus ---------------------------

TUI_CYCLE = ["T047", "T121", "T184", "T033", "T061", "T023", "T046", "T191", "T037", "T078", "T079", "T081"]
DICT_WORDS, DICT_SENSES, DICT_PAIRS = 200, 40, 50


def _cui(number: Column) -> Column:
    return F.concat(F.lit("C"), F.lpad(number.cast("string"), 7, "0"))


def _entry(phrase: str, rank: Column, shift: int, tui_shift: int, scheme: Column, freq: Column) -> list[Column]:
    tuis = F.array(*[F.lit(t) for t in TUI_CYCLE])
    place = ((rank - 1 + tui_shift) % len(TUI_CYCLE)).cast("int")
    return [
        F.col(phrase).alias("phrase"), _cui(rank + shift).alias("cui"), tuis[place].alias("tui"),
        (rank + 100000 + shift).cast("string").alias("code"), scheme.alias("scheme"), freq.cast("bigint").alias("freq"),
    ]


def concept_dictionary(notes: DataFrame) -> DataFrame:
    """The most frequent words (some with two senses) and word pairs of the corpus, 290 rows."""
    words = T.words_of(notes).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    top = stage(top_ranked(words, [F.desc("n"), F.asc("word")], DICT_WORDS, "r"))
    pairs = notes.select(
        F.explode(
            F.zip_with(
                F.slice("tokens", F.lit(1), F.greatest(F.size("tokens") - 1, F.lit(0))),
                F.slice("tokens", F.lit(2), F.greatest(F.size("tokens") - 1, F.lit(0))),
                lambda a, b: F.concat_ws(" ", a, b),
            )
        ).alias("word")
    )
    top_pairs = top_ranked(
        pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n")), [F.desc("n"), F.asc("word")], DICT_PAIRS, "r"
    )
    r, n = F.col("r"), F.col("n")
    parity = F.when(r % 5 == 0, "ICD10").when(r % 2 == 1, "SNOMEDCT").otherwise("RXNORM")
    first = top.select(*_entry("word", r, 0, 0, parity, n))
    second = top.where(r <= DICT_SENSES).select(*_entry("word", r, 5000, 4, F.lit("SNOMEDCT"), F.floor(n / 2)))
    double = top_pairs.select(*_entry("word", r, 9000, 2, F.lit("SNOMEDCT"), n))
    return stage(first.unionByName(second).unionByName(double))


def dictionary_sql() -> str:
    """CTEs ``notes``, ``dict``."""
    from noteforge.plans.sqltext import listed, notes

    tuis = f"[{listed(TUI_CYCLE)}]"

    def entry(shift: int, tui_shift: int, scheme: str, freq: str) -> str:
        return (
            f"SELECT w AS phrase, 'C' || lpad(CAST(r + {shift} AS VARCHAR), 7, '0') AS cui, "
            f"{tuis}[((r - 1 + {tui_shift}) % {len(TUI_CYCLE)}) + 1] AS tui, "
            f"CAST(r + 100000 + {shift} AS VARCHAR) AS code, {scheme} AS scheme, CAST({freq} AS BIGINT) AS freq"
        )

    return (
        notes(content=False)
        + ", uni AS (SELECT w, n, row_number() OVER (ORDER BY n DESC, w) AS r FROM "
        "(SELECT w, count(*) AS n FROM (SELECT unnest(toks) AS w FROM notes) GROUP BY w) "
        f"QUALIFY r <= {DICT_WORDS})"
        ", bi AS (SELECT w, n, row_number() OVER (ORDER BY n DESC, w) AS r FROM "
        "(SELECT w, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(toks)), "
        "lambda i: toks[i] || ' ' || toks[i + 1])) AS w FROM notes) GROUP BY w) "
        f"QUALIFY r <= {DICT_PAIRS})"
        ", dict AS ("
        + entry(0, 0, "CASE WHEN r % 5 = 0 THEN 'ICD10' WHEN r % 2 = 1 THEN 'SNOMEDCT' ELSE 'RXNORM' END", "n")
        + " FROM uni UNION ALL "
        + entry(5000, 4, "'SNOMEDCT'", "n // 2")
        + f" FROM uni WHERE r <= {DICT_SENSES} UNION ALL "
        + entry(9000, 2, "'SNOMEDCT'", "n")
        + " FROM bi)"
    )


SENSE_WORDS = 40  # words with two senses each; as many words stand for either sense alone


def sense_dictionary(notes: DataFrame) -> DataFrame:
    """``(phrase, cui, freq)``: frequent words with two senses, and for either sense a word that has no other."""
    words = T.words_of(notes).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    top = stage(top_ranked(words, [F.desc("n"), F.asc("word")], 3 * SENSE_WORDS, "r"))
    place = (F.col("r") - 1) % SENSE_WORDS + 1
    first = top.where(F.col("r") <= 2 * SENSE_WORDS).select(F.col("word").alias("phrase"), _cui(place).alias("cui"), F.col("n").alias("freq"))
    second = top.where((F.col("r") <= SENSE_WORDS) | (F.col("r") > 2 * SENSE_WORDS)).select(
        F.col("word").alias("phrase"), _cui(place + 5000).alias("cui"), F.floor(F.col("n") / 2).cast("bigint").alias("freq")
    )
    return stage(first.unionByName(second))


def sense_dictionary_sql() -> str:
    """CTEs ``notes``, ``dict``."""
    from noteforge.plans.sqltext import notes

    k = SENSE_WORDS
    return (
        notes(content=False)
        + ", uni AS (SELECT w, n, row_number() OVER (ORDER BY n DESC, w) AS r FROM "
        f"(SELECT w, count(*) AS n FROM (SELECT unnest(toks) AS w FROM notes) GROUP BY w) QUALIFY r <= {3 * k})"
        f", dict AS (SELECT w AS phrase, 'C' || lpad(CAST((r - 1) % {k} + 1 AS VARCHAR), 7, '0') AS cui, n AS freq FROM uni WHERE r <= {2 * k} "
        f"UNION ALL SELECT w, 'C' || lpad(CAST((r - 1) % {k} + 5001 AS VARCHAR), 7, '0'), n // 2 FROM uni WHERE r <= {k} OR r > {2 * k})"
    )


LONGEST_PHRASE = 8


def long_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """``(phrase, cui)``: runs of 1 to 8 words of the benchmark passages, each run of two to eight words by the place it starts at."""
    items = table(spark, sf, "benchmark").select("item_id", X.tokenize("text").alias("toks"))
    starts = F.sequence(F.lit(1), F.size("toks"))
    run = F.transform(starts, lambda i: F.struct((i - 1).alias("at"), F.slice("toks", i, (i - 1) % LONGEST_PHRASE + 1).alias("w")))
    rows = items.select("item_id", F.inline(run)).where(F.size("w") == F.col("at") % LONGEST_PHRASE + 1)
    phrases = rows.groupBy(F.array_join("w", " ").alias("phrase")).agg(F.min(F.struct("item_id", "at")).alias("first"))
    return phrases.select("phrase", F.concat_ws("-", F.lit("B"), "first.item_id", "first.at").alias("cui"))


def long_phrases_sql() -> str:
    """CTEs ``notes``, ``phr``."""
    from noteforge.plans.sqltext import notes, tokens

    n = LONGEST_PHRASE
    return (
        notes(content=False)
        + f", items AS (SELECT item_id, {tokens()} AS toks FROM benchmark)"
        f", cuts AS (SELECT item_id, i - 1 AS spot, toks[i : i + (i - 1) % {n}] AS w FROM (SELECT item_id, toks, unnest(range(1, len(toks) + 1)) AS i FROM items))"
        f", phr AS (SELECT array_to_string(w, ' ') AS phrase, arg_min('B-' || item_id || '-' || spot, (item_id, spot)) AS cui FROM cuts WHERE len(w) = spot % {n} + 1 GROUP BY 1)"
    )


def matched(spark: SparkSession, sf: str) -> DataFrame:
    dictionary = concept_dictionary(corpus_tokens(spark, sf, stop=False))
    return C.concept_match(doc_tokens(spark, sf, stop=False), "doc_id", dictionary, staged=True)


def annotated(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a ``concepts`` array."""
    best = C.concept_best(matched(spark, sf), "doc_id")
    return C.annotate(table(spark, sf, "documents").select("doc_id", "text"), best, "doc_id")


# --- word vectors computed from the word itself ------------------------------

DIM = 8


def word_vector(word: Column, dim: int = DIM) -> Column:
    parts = [
        (((F.ascii(word) * (i + 1) + F.length(word) * (i + 3) + F.ascii(F.reverse(word)) * 5) % 11) - 5) / F.lit(13.7)
        for i in range(dim)
    ]
    return F.array(*parts)


def word_vector_sql(word: str = "word", dim: int = DIM) -> list[str]:
    return [
        f"(((ascii({word}) * {i + 1} + length({word}) * {i + 3} + ascii(reverse({word})) * 5) % 11) - 5) / 13.7::DOUBLE"
        for i in range(dim)
    ]


def word_vectors(words: DataFrame) -> DataFrame:
    """Vectors of the words with an even length; the others have none."""
    known = words.select("word").distinct().where(F.length("word") % 2 == 0)
    return known.select("word", word_vector(F.col("word")).alias("vec"))


# --- a fixed rule that predicts the language ---------------------------------


def rule_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """``(doc_id, true, pred, probs)`` from counts of a few function words."""
    docs = table(spark, sf, "documents", "doc_id").select("doc_id", F.col("lang").alias("true"), X.tokenize("text").alias("tokens"))

    def occurrences(words: list[str]) -> Column:
        return F.size(F.filter("tokens", lambda t: t.isin(words)))

    counts = F.array(*[occurrences(words) for words in CUES.values()])
    docs = docs.withColumn("n", counts)
    names = F.array(*[F.lit(c) for c in CUES])
    total = F.aggregate("n", F.lit(0), lambda s, x: s + x)
    return docs.select(
        "doc_id", "true",
        names[argmax("n").cast("int")].alias("pred"),
        F.transform("n", lambda x: (x + 1.0) / (total + len(CUES))).alias("probs"),
    )



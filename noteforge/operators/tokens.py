"""Token tables, dictionaries and id sequences.

Frames entering these operators have one row per note. They are hashed by the
note key while they are still one row per note; the explode, the per-note
aggregates and the per-note windows after it then need no further shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteforge import fixed
from noteforge.functions import text as X
from noteforge.functions.stem import stem_words
from noteforge.operators.joins import is_small, lookup_join
from noteforge.operators.ranking import top_ranked
from noteforge.runtime import dealt_by, stage

Tokenizer = Callable[[Column], Column]


def tokenized(df: DataFrame, key: str, text: str = "text", tokenizer: Tokenizer = X.tokenize,
              hashed: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(key, keep..., tokens)``.

    Hash by key when per-note results follow. Corpus-wide counts combine on
    the map side and want the rows where they lie: ``hashed=False``.
    """
    df = df.select(key, *keep, text)
    if hashed:
        df = dealt_by(df, key)
    tokens = F.coalesce(tokenizer(F.col(text)), F.array().cast("array<string>")).alias("tokens")
    return df.select(key, *keep, tokens)


def exploded(df: DataFrame, key: str, values: Column | str, pos: str, value: str) -> DataFrame:
    """``(key, pos, value)``, positions from 1.

    The outer generator is on purpose: from a plain one the optimizer derives
    a non-empty filter below the shuffle, which computes ``values`` twice.
    """
    rows = df.select(key, F.posexplode_outer(values).alias("_p", value)).where(F.col("_p").isNotNull())
    return rows.select(key, (F.col("_p") + 1).cast("bigint").alias(pos), value)


def token_rows(notes: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
    """``(key, pos, word)``, positions from 1."""
    return exploded(notes, key, tokens, "pos", "word")


def words_of(notes: DataFrame, tokens: str = "tokens") -> DataFrame:
    return notes.select(F.explode_outer(tokens).alias("word")).where(F.col("word").isNotNull())


def text_words(df: DataFrame, text: str = "text", stop_words=tuple(fixed.STOP_WORDS), keep: tuple[str, ...] = ()) -> DataFrame:
    """``(keep..., word)`` straight from the text.

    The same words as :func:`noteforge.functions.text.tokenize`, but filtered
    after the explode, where the tests are compiled with the scan and the
    partial count behind it.
    """
    word = F.col("word")
    rows = df.select(*keep, F.explode(F.split(F.lower(text), X.WORD_GAP)).alias("word"))
    rows = rows.where((F.length(word) > 2) & ~word.rlike("^[0-9.]"))
    return rows.where(~word.isin(list(stop_words))) if stop_words else rows


def vocabulary(words: DataFrame, size: int | None = 1_000_000) -> DataFrame:
    """``(word, n, id)``: ids by falling frequency, slot 0 for rare words.

    ``size`` counts the rare slot; ``None`` keeps every word.
    """
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    limit = None if size is None else size - 1
    ranked = top_ranked(counts, [F.desc("n"), F.asc("word")], limit, "id")
    rare = words.sparkSession.range(1).select(
        F.lit(fixed.RARE_WORD).alias("word"), F.lit(-1).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("id")
    )
    return ranked.select("word", "n", "id").unionByName(rare)


def to_ids(notes: DataFrame, key: str, vocab: DataFrame, tokens: str = "tokens", staged: bool = False) -> DataFrame:
    """``(key, ids)`` in token order; words outside the dictionary become 0."""
    known = vocab.where(F.col("id") > 0).select("word", F.col("id").alias("_id"))
    # a note without tokens keeps one row without a position, and so its key
    rows = notes.select(key, F.posexplode_outer(tokens).alias("pos", "word")).withColumn("word", F.coalesce("word", F.lit("")))
    rows = lookup_join(rows, known, "word", "left", spread_by=[key, "pos"], staged=staged)
    item = F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("_id", F.lit(0)).alias("_id")))
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("_s")).select(key, F.col("_s._id").alias("ids"))


def to_words(sequences: DataFrame, key: str, vocab: DataFrame, ids: str = "ids") -> DataFrame:
    """The inverse of :func:`to_ids`; id 0 comes back as the rare word."""
    rows = sequences.select(key, F.posexplode(ids).alias("pos", "_id"))
    names = vocab.select(F.col("id").alias("_id"), "word")
    named = lookup_join(rows, names, "_id", "inner", spread_by=[key, "pos"])
    return named.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("_s")
    ).select(key, F.col("_s.word").alias("words"))


def longest(sequences: DataFrame, ids: str = "ids") -> DataFrame:
    return sequences.agg(F.max(F.size(ids)).cast("bigint").alias("max_len"))


def term_counts(notes: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
    """``(key, word, n)`` in long form."""
    rows = notes.select(key, F.explode_outer(tokens).alias("word")).where(F.col("word").isNotNull())
    return rows.groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))


def text_counts(df: DataFrame, key: str, text: str = "text", stop_words=tuple(fixed.STOP_WORDS)) -> DataFrame:
    """``(key, word, n)`` straight from the text, hashed by key for what follows."""
    words = text_words(dealt_by(df.select(key, text), key), text, stop_words, keep=(key,))
    return words.groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))


def document_frequency(notes: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``(word, df)``: notes containing the word; repeats vanish inside each row."""
    each = notes.select(F.explode_outer(F.array_distinct(tokens)).alias("word")).where(F.col("word").isNotNull())
    return each.groupBy("word").agg(F.count(F.lit(1)).alias("df"))


def fixed_term_counts(notes: DataFrame, key: str, vocab: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Counts of stored dictionary words only: ``(key, id, n)``."""
    known = stage(vocab.where(F.col("id") > 0).select("word", "id"))
    if is_small(known):  # only the words that count are held
        rows = notes.select(key, F.explode_outer(tokens).alias("word")).join(F.broadcast(known), "word")
        return rows.groupBy(key, "word", "id").agg(F.count(F.lit(1)).alias("n")).select(key, "id", "n")
    counts = term_counts(notes, key, tokens)
    return lookup_join(counts, known, "word", spread_by=[key, "word"], staged=True).select(key, "id", "n")


def stem_counts(words: DataFrame) -> DataFrame:
    """Occurrences per stem. Words are counted first, so each is stemmed once."""
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return stem_words(counts, "word").groupBy("stem").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")
    )


def stemmed(notes: DataFrame, key: str, words: DataFrame | None = None, tokens: str = "tokens") -> DataFrame:
    """``(key, tokens)`` with every token replaced by its stem.

    ``words`` lists (at least) the words to stem; by default those of ``notes``.
    """
    stems = stem_words((words_of(notes, tokens) if words is None else words).distinct(), "word")
    rows = lookup_join(token_rows(notes, key, tokens), stems, "word", spread_by=[key, "pos"])
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "stem"))).alias("_s"))
    return notes.select(key).join(lists, key, "left").select(
        key, F.coalesce(F.col("_s.stem"), F.array().cast("array<string>")).alias("tokens")
    )


def sentence_rows(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``(key, sentence_no, sentence)``, numbered from 1."""
    return exploded(df, key, X.sentences(text), "sentence_no", "sentence")


def line_rows(df: DataFrame, key: str, text: str = "text", newline: str = "\r\n") -> DataFrame:
    """``(key, line_no, line)`` of the non-empty lines."""
    return df.select(key, F.inline_outer(X.clean_lines(text, newline))).where(F.col("line_no").isNotNull())


def phi_report(df: DataFrame, key: str, text: str = "text", rules=tuple(fixed.PHI_RULES)) -> DataFrame:
    """Findings and affected notes per kind of personal data.

    Each rule sees the text the earlier rules have already masked, so one
    string is reported once. Counting happens inside the row.
    """
    masked = df.select(key, F.col(text).alias("_rest"))
    for kind, pattern in rules:
        hits = F.size(F.regexp_extract_all("_rest", F.lit(pattern), F.lit(0))).cast("bigint")
        masked = masked.withColumns(
            {f"_{kind}": hits, "_rest": F.regexp_replace("_rest", pattern, f"[**{kind}**]")}
        )
    found = [F.struct(F.lit(kind).alias("kind"), F.col(f"_{kind}").alias("hits")) for kind, _ in rules]
    rows = masked.select(key, F.inline(F.array(*found))).where(F.col("hits") > 0)
    return rows.groupBy("kind").agg(F.sum("hits").alias("findings"), F.count(F.lit(1)).alias("notes"))

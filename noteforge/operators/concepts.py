"""Concept annotations: recognition, pruning, disambiguation, per-note code sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteforge import fixed
from noteforge.operators.joins import is_small, lookup_join
from noteforge.runtime import stage

MAX_PHRASE_WORDS = 3
CONCEPT_TYPE = "array<struct<cui:string,tui:string,code:string,scheme:string>>"


def prefixed_code(scheme: Column, code: Column) -> Column:
    """One-letter scheme prefix; other schemes get none."""
    out = code
    for name, letter in fixed.SCHEME_PREFIX.items():
        out = F.when(scheme == name, F.concat(F.lit(letter), code)).otherwise(out)
    return out


def concept_rows(notes: DataFrame, key: str) -> DataFrame:
    """One row per annotation: ``(key, cui, tui, code, scheme)``."""
    return notes.select(key, F.inline("concepts")).withColumn(
        "code", prefixed_code(F.col("scheme"), F.col("code"))
    )


def in_group(tui: Column) -> Column:
    return tui.isin(fixed.SEMANTIC_GROUP_TUIS)


def in_type(tui: Column) -> Column:
    return tui.isin(fixed.SEMANTIC_TYPE_TUIS)


def code_sets(concepts: Column | str) -> dict[str, Column]:
    """The four distinct, sorted code sets of one note's ``concepts`` array.

    All work stays inside the row: nothing is exploded or shuffled.
    """
    concepts = F.col(concepts) if isinstance(concepts, str) else concepts

    def codes(keep, value):
        kept = F.filter(concepts, keep) if keep else concepts
        return F.array_sort(F.array_distinct(F.transform(kept, value)))

    return {
        "snomed": codes(
            lambda c: c["scheme"] == fixed.SNOMED_SCHEME, lambda c: prefixed_code(c["scheme"], c["code"])
        ),
        "umls": codes(None, lambda c: c["cui"]),
        "sg": codes(lambda c: in_group(c["tui"]), lambda c: c["cui"]),
        "st": codes(lambda c: in_type(c["tui"]), lambda c: c["cui"]),
    }


def note_columns(notes: DataFrame, concepts: str = "concepts", sentinel: str | None = fixed.NO_ANNOTATION) -> DataFrame:
    """Add ``snomed, umls, sg, st`` as space-joined sets.

    A note without annotations keeps its text and gets ``sentinel`` in all
    four (``None`` leaves nulls).
    """
    empty = F.col(concepts).isNull() | (F.size(concepts) == 0)
    return notes.withColumns(
        {
            name: F.when(empty, F.lit(sentinel)).otherwise(F.array_join(codes, " "))
            for name, codes in code_sets(concepts).items()
        }
    )


def phrases(notes: DataFrame, key: str, tokens: str = "tokens", max_words: int = MAX_PHRASE_WORDS) -> DataFrame:
    """Every run of 1..max_words tokens: ``(key, start, words, phrase)``."""
    t = F.col(tokens)

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(t) - n + 1)
        made = F.transform(
            starts,
            lambda i: F.struct(
                i.cast("bigint").alias("start"),
                F.lit(n).cast("bigint").alias("words"),
                F.array_join(F.slice(t, i, F.lit(n)), " ").alias("phrase"),
            ),
        )
        return F.when(F.size(t) >= n, made).otherwise(F.array().cast("array<struct<start:bigint,words:bigint,phrase:string>>"))

    return notes.select(key, F.inline(F.concat(*[runs(n) for n in range(1, max_words + 1)])))


def concept_match(notes: DataFrame, key: str, dictionary: DataFrame, tokens: str = "tokens",
                  max_words: int = MAX_PHRASE_WORDS, staged: bool = False) -> DataFrame:
    """All dictionary senses of all phrases.

    ``dictionary`` has ``(phrase, cui, tui, code, scheme)`` and optionally ``freq``.
    """
    dictionary = dictionary if staged else stage(dictionary)
    runs = _likely_runs(notes, key, dictionary, tokens, max_words)
    return lookup_join(runs, dictionary, "phrase", spread_by=[key, "start", "words"], staged=True)


def _likely_runs(notes: DataFrame, key: str, dictionary: DataFrame, tokens: str, max_words: int) -> DataFrame:
    """The runs of :func:`phrases` that may be a phrase of the dictionary, by the first word and the number of words.

    Only for these a text is put together. A phrase may hold more blanks than its run has gaps,
    as tokens may hold some, and fewer, as null tokens are left out; such runs stay in.
    """
    first = F.substring_index("phrase", " ", 1)
    firsts = dictionary.groupBy(first.alias("_first")).agg(F.max(F.size(F.split("phrase", " "))).alias("_most"))
    none = dictionary.sparkSession.range(1).select(F.lit(None).cast("string").alias("_first"), F.lit(max_words).alias("_most"))
    firsts = stage(firsts.where(F.col("_first").isNotNull()).unionByName(none))
    if not is_small(firsts):
        return phrases(notes, key, tokens, max_words)
    t = F.col(tokens)
    rest = [F.get(t, F.col("_i") + n).alias(f"_w{n}") for n in range(1, max_words)]
    # outer, so that no filter is inferred that computes the tokens again
    places = notes.select(key, t, F.posexplode_outer(t).alias("_i", "_w0")).where(F.col("_i").isNotNull())
    places = places.join(F.broadcast(firsts), F.substring_index("_w0", " ", 1).eqNullSafe(F.col("_first")))
    places = places.select(key, (F.col("_i") + 1).cast("bigint").alias("start"), (F.size(t) - F.col("_i")).alias("_room"), "_most", "_w0", *rest)
    runs, gap = [], F.lit(False)
    for n in range(1, max_words + 1):
        gap = gap | F.col(f"_w{n - 1}").isNull()
        run = F.struct(F.lit(n).cast("bigint").alias("words"), F.concat_ws(" ", *[f"_w{i}" for i in range(n)]).alias("phrase"))
        runs.append(F.when((F.col("_room") >= n) & ((F.col("_most") >= n) | gap), run))
    rows = places.select(key, "start", F.explode_outer(F.array(*runs)).alias("_r")).where(F.col("_r").isNotNull())
    return rows.select(key, "start", "_r.words", "_r.phrase")


def concept_score(max_words: int = MAX_PHRASE_WORDS) -> Column:
    """Share of the longest possible phrase that the match covers."""
    return F.col("words") / F.lit(float(max_words))


def concept_prune(matches: DataFrame, key: str, threshold: float = 0.0, keep: int = 20,
                  max_words: int = MAX_PHRASE_WORDS) -> DataFrame:
    """Candidates scoring at least ``threshold``, the best ``keep`` per start position."""
    span = Window.partitionBy(key, "start").orderBy(F.desc("score"), "cui", "code")
    return (
        matches.withColumn("score", concept_score(max_words))
        .where(F.col("score") >= threshold)
        .withColumn("candidate", F.row_number().over(span).cast("bigint"))
        .where(F.col("candidate") <= keep)
    )


def concept_best(matches: DataFrame, key: str) -> DataFrame:
    """One sense per start position: longest phrase, then most frequent sense, then cui."""
    span = Window.partitionBy(key, "start").orderBy(F.desc("words"), F.desc("freq"), "cui", "code")
    return matches.withColumn("_rn", F.row_number().over(span)).where(F.col("_rn") == 1).drop("_rn")


def concept_longest(best: DataFrame, key: str) -> DataFrame:
    """Matches that no longer match covers; ``best`` has one match per start position."""
    before = Window.partitionBy(key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    last = F.col("start") + F.col("words") - 1
    covered = F.coalesce(F.max(last).over(before), F.lit(0)) >= last
    return best.withColumn("_covered", covered).where(~F.col("_covered")).drop("_covered")


def annotate(notes: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    """Attach matches to their notes as a ``concepts`` array; notes without any get an empty one."""
    lists = matches.groupBy(key).agg(
        F.collect_set(F.struct("cui", "tui", "code", "scheme")).alias("concepts")
    )
    return notes.join(lists, key, "left").withColumn(
        "concepts", F.coalesce("concepts", F.array().cast(CONCEPT_TYPE))
    )

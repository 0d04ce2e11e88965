"""Suffix stripping as columns.

Over a vocabulary table, stems are computed once per distinct word, and each step
is a projection. The same steps also make one expression for a single word, for
token arrays that must be stemmed in place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteforge import fixed
from noteforge.functions.text import bound


def shape(word: Column) -> Column:
    """Letters as V or C; ``y`` is a vowel only after a consonant."""
    marked = F.regexp_replace(word, "(^|[aeiou])y", "$1j")
    return F.regexp_replace(F.translate(marked, "aeiouy", "VVVVVV"), "[^V]", "C")


def measure(word: Column) -> Column:
    """Number of vowel-to-consonant turns."""
    letters = shape(word)
    return ((F.length(letters) - F.length(F.replace(letters, F.lit("VC"), F.lit("")))) / 2).cast("int")


def has_vowel(word: Column) -> Column:
    return F.contains(shape(word), F.lit("V"))


def ends_cvc(word: Column) -> Column:
    return shape(word).endswith("CVC") & ~word.rlike("[wxy]$")


def ends_double(word: Column, letters: str | None = None) -> Column:
    same = (F.length(word) > 1) & (F.substring(word, -1, 1) == F.substring(word, -2, 1))
    if letters is not None:
        return same & word.rlike(f"[{letters}]$")
    return same & shape(word).endswith("C")


def _cut(word: Column, n: Column | int) -> Column:
    return F.substring(word, F.lit(1), (F.length(word) - n).cast("int"))


def _suffix(word: Column, endings) -> Column:
    """The longest of the endings that the word has, or an empty string."""
    return F.regexp_extract(word, "(" + "|".join(sorted(endings, key=len, reverse=True)) + ")$", 1)


def _split(word: Column, endings, body: Callable[[Column, Column], Column]) -> Column:
    """``body(suffix, rest)``, each computed once."""
    return bound(_suffix(word, endings), lambda suf: bound(_cut(word, F.length(suf)), lambda rest: body(suf, rest)))


def plural(w: Column) -> Column:
    """1a: plural endings."""
    return (
        F.when(w.endswith("sses") | w.endswith("ies"), _cut(w, 2))
        .when(w.endswith("ss"), w)
        .when(w.endswith("s"), _cut(w, 1))
        .otherwise(w)
    )


def past(w: Column) -> Column:
    """1b: past and gerund endings; what is left is repaired."""

    def body(suf: Column, rest: Column) -> Column:
        repaired = (
            F.when(rest.rlike("(at|bl|iz)$"), F.concat(rest, F.lit("e")))
            .when(ends_double(rest) & ~rest.rlike("[lsz]$"), _cut(rest, 1))
            .when((measure(rest) == 1) & ends_cvc(rest), F.concat(rest, F.lit("e")))
            .otherwise(rest)
        )
        return (
            F.when((suf == "eed") & (measure(rest) > 0), F.concat(rest, F.lit("ee")))
            .when(suf.isin("ed", "ing") & has_vowel(rest), repaired)
            .otherwise(w)
        )

    return F.when(w.rlike("(ed|ing)$"), _split(w, ["eed", "ed", "ing"], body)).otherwise(w)


def final_y(w: Column) -> Column:
    """1c."""
    return F.when(w.endswith("y") & has_vowel(_cut(w, 1)), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w)


def double_suffix(rules: dict[str, str]) -> Callable[[Column], Column]:
    """2 and 3: the longest listed suffix is replaced when the rest measures above 0."""
    table = lambda suf: F.create_map(*[F.lit(x) for pair in rules.items() for x in pair])[suf]

    def step(w: Column) -> Column:
        body = lambda suf, rest: F.when((suf != "") & (measure(rest) > 0), F.concat(rest, table(suf))).otherwise(w)
        return _split(w, rules, body)

    return step


def single_suffix(w: Column) -> Column:
    """4: ``ion`` needs a preceding s or t."""

    def body(suf: Column, rest: Column) -> Column:
        fits = (suf != "") & (measure(rest) > 1) & ((suf != "ion") | rest.rlike("[st]$"))
        return F.when(fits, rest).otherwise(w)

    return _split(w, fixed.PORTER_STEP4, body)


def final_e(w: Column) -> Column:
    """5a."""
    rest = _cut(w, 1)
    return F.when(w.endswith("e") & ((measure(rest) > 1) | ((measure(rest) == 1) & ~ends_cvc(rest))), rest).otherwise(w)


def final_l(w: Column) -> Column:
    """5b."""
    return F.when(w.endswith("ll") & (measure(w) > 1), _cut(w, 1)).otherwise(w)


STEPS = (
    plural, past, final_y, double_suffix(fixed.PORTER_STEP2), double_suffix(fixed.PORTER_STEP3), single_suffix, final_e, final_l,
)


def stem_word(word: Column) -> Column:
    """The stem of a word, for use inside other expressions; every step is computed once."""

    def after(steps, w: Column) -> Column:
        return bound(steps[0](w), lambda x: after(steps[1:], x)) if steps else w

    return F.when(F.length(word) < 3, word).otherwise(after(STEPS, word))


def stem_words(words: DataFrame, word: str, out: str = "stem") -> DataFrame:
    """Add ``out``, the stem of ``word``: a projection for each step."""
    df = words.withColumn("_w", F.col(word))
    for step in STEPS:
        df = df.withColumn("_w", step(F.col("_w")))
    return df.withColumn(out, F.when(F.length(word) < 3, F.col(word)).otherwise(F.col("_w"))).drop("_w")

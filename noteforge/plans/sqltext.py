"""SQL fragments shared by the check queries."""

from __future__ import annotations

from collections.abc import Iterable

from noteforge import fixed


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(values: Iterable[str]) -> str:
    return ", ".join(quoted(v) for v in values)


STOP = listed(fixed.STOP_WORDS)
GAP = r"'[^\p{L}\p{N}_]+'"


def tokens(text: str = "text") -> str:
    return (
        f"list_filter(regexp_split_to_array(lower({text}), {GAP}), "
        "lambda t: length(t) > 2 AND NOT regexp_matches(t, '^[0-9.]'))"
    )


def content_tokens(text: str = "text") -> str:
    return f"list_filter({tokens(text)}, lambda t: t NOT IN ({STOP}))"


def words_ws(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '\\s+'), lambda t: t <> '')"


def notes(text: str = "text", content: bool = True) -> str:
    make = content_tokens if content else tokens
    return f"notes AS (SELECT doc_id, lang, {make(text)} AS toks FROM documents)"


def word_rows(source: str = "notes") -> str:
    return (
        f"words AS (SELECT doc_id, lang, unnest(toks) AS word, generate_subscripts(toks, 1) AS pos FROM {source})"
    )


# The folds of the first repeat over all documents, stratified by language.
FOLDS = (
    "folds AS (SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang "
    "ORDER BY md5(doc_id || '|1'), doc_id) - 1) % 5 AS fold FROM documents)"
)

# A fixed rule that guesses the language from a few function words.
CUES = {"de": ["der", "die", "und"], "en": ["the", "and", "of"], "es": ["que", "los", "del"], "fr": ["les", "des", "est"]}


def cue_counts(toks: str = "toks") -> dict[str, str]:
    return {c: f"len(list_filter({toks}, lambda t: t IN ({listed(w)})))" for c, w in CUES.items()}


def rule_predictions() -> str:
    """CTEs ``cues(doc_id, lang, n_*)`` and ``preds(doc_id, truth, pred, p_*)``."""
    counts = ", ".join(f"{e} AS n_{c}" for c, e in cue_counts().items())
    total = " + ".join(f"n_{c}" for c in CUES)
    probs = ", ".join(f"(n_{c} + 1.0::DOUBLE) / ({total} + {len(CUES)}) AS p_{c}" for c in CUES)
    best = "CASE " + " ".join(
        f"WHEN n_{c} >= ALL_MAX THEN {quoted(c)}" for c in CUES
    ).replace("ALL_MAX", "greatest(" + ", ".join(f"n_{c}" for c in CUES) + ")") + " END"
    return (
        f"{notes(content=False)}, cues AS (SELECT doc_id, lang, {counts} FROM notes), "
        f"preds AS (SELECT doc_id, lang AS truth, {best} AS pred, {probs} FROM cues)"
    )

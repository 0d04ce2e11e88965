"""Queries over note text: cleanup, de-identification, tokens, sentences."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteforge import fixed
from noteforge.functions import text as X
from noteforge.functions.stem import stem_word
from noteforge.operators import tokens as T
from noteforge.plans import sqltext as S
from noteforge.plans.catalog import query
from noteforge.plans.inputs import corpus_words, doc_tokens, documents
from noteforge.sources.readers import table

# documents carry no markup or record markers, so both sides wrap them the same way
def _wrapped():
    return F.concat(
        F.lit(f"{fixed.RECORD_START}\r\n<p>"), F.col("text"), F.lit(f"</p><br />\t<b>End</b>\n{fixed.RECORD_END}")
    )


WRAPPED_SQL = (
    f"'{fixed.RECORD_START}' || chr(13) || chr(10) || '<p>' || text || '</p><br />' || chr(9) || '<b>End</b>' "
    f"|| chr(10) || '{fixed.RECORD_END}'"
)


def _drop_sql(text: str, literals) -> str:
    for literal in literals:
        text = f"replace({text}, {S.quoted(literal)}, '')"
    return text


@query(
    "clean_note",
    "SELECT doc_id, lower("
    + _drop_sql(
        f"replace(replace(replace({WRAPPED_SQL}, chr(10), ' '), chr(13), ''), chr(9), ' ')",
        [*fixed.NOTE_MARKUP, fixed.RECORD_START, fixed.RECORD_END],
    )
    + ") AS bow FROM documents",
)
def clean_note(spark, sf):
    return documents(spark, sf).select("doc_id", X.clean_note(_wrapped()).alias("bow"))


@query(
    "trim_header",
    "SELECT doc_id, "
    + _drop_sql(
        f"array_to_string(string_split({WRAPPED_SQL}, chr(10))[3:], chr(10))",
        [fixed.RECORD_START, fixed.RECORD_END],
    )
    + " AS body FROM documents",
)
def trim_header(spark, sf):
    return documents(spark, sf).select("doc_id", X.trim_header(_wrapped()).alias("body"))


def _deid_sql(text: str) -> str:
    for kind, pattern in fixed.PHI_RULES:
        text = f"regexp_replace({text}, {S.quoted(pattern)}, '[**{kind}**]', 'g')"
    return text


@query("deid_text", f"SELECT doc_id, {_deid_sql('text')} AS text FROM documents")
def deid_text(spark, sf):
    return documents(spark, sf).select("doc_id", X.deidentify("text").alias("text"))


@query(
    "deid_strip",
    f"SELECT doc_id, regexp_replace({_deid_sql('text')}, {S.quoted(fixed.PLACEHOLDER_PATTERN)}, '', 'g') AS text "
    "FROM documents",
)
def deid_strip(spark, sf):
    return documents(spark, sf).select("doc_id", X.strip_placeholders(X.deidentify("text")).alias("text"))


def _phi_report_sql() -> str:
    ctes, found, before = [], [], "documents"
    for i, (kind, pattern) in enumerate(fixed.PHI_RULES):
        ctes.append(
            f"m{i} AS (SELECT doc_id, regexp_replace(text, {S.quoted(pattern)}, '[**{kind}**]', 'g') AS text, "
            f"len(regexp_extract_all(text, {S.quoted(pattern)})) AS hits FROM {before})"
        )
        found.append(f"SELECT '{kind}' AS kind, doc_id, hits FROM m{i} WHERE hits > 0")
        before = f"m{i}"
    return (
        f"WITH {', '.join(ctes)} SELECT kind, CAST(sum(hits) AS BIGINT) AS findings, count(*) AS notes "
        f"FROM ({' UNION ALL '.join(found)}) GROUP BY kind"
    )


@query("phi_report", _phi_report_sql())
def phi_report(spark, sf):
    return T.phi_report(documents(spark, sf), "doc_id")


def _html_sql() -> str:
    text = "html"
    for pattern in (
        "(?s)<!--.*?-->", "(?is)<script[^>]*>.*?</script>", "(?is)<style[^>]*>.*?</style>", "<[a-zA-Z/!?][^>]*>",
    ):
        text = f"regexp_replace({text}, {S.quoted(pattern)}, '', 'g')"
    for name, char in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("nbsp", " "), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        text = f"replace({text}, '&{name};', {S.quoted(char)})"
    return text


@query("html_text", f"SELECT page_id, {_html_sql()} AS text FROM pages")
def html_text(spark, sf):
    return table(spark, sf, "pages", "page_id").select("page_id", X.html_text("html").alias("text"))


@query(
    "norm_alnum",
    "SELECT doc_id, lower(regexp_replace(replace(text, chr(13) || chr(10), ' '), '[^a-zA-Z0-9_]', ' ', 'g')) AS text "
    "FROM documents",
)
def norm_alnum(spark, sf):
    return documents(spark, sf).select("doc_id", X.norm_alnum("text").alias("text"))


@query(
    "norm_text",
    "SELECT doc_id, array_to_string(list_filter("
    + S.words_ws(f"translate(lower(text), {S.quoted(fixed.PUNCTUATION + fixed.DIGITS)}, '')")
    + f", lambda t: t NOT IN ({S.STOP})), ' ') AS text FROM documents",
)
def norm_text(spark, sf):
    return documents(spark, sf).select("doc_id", X.norm_text("text").alias("text"))


@query(
    "clean_lines",
    "WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, "
    "generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents) "
    "SELECT doc_id, line_no, translate(lower(line), "
    f"{S.quoted(fixed.PUNCTUATION)} || chr(10) || chr(13), '{' ' * (len(fixed.PUNCTUATION) + 2)}') AS line "
    "FROM lines WHERE line <> ''",
)
def clean_lines(spark, sf):
    return T.line_rows(documents(spark, sf), "doc_id", newline="\n")


@query(
    "feature_concat",
    "SELECT conv_id, turn, concat_ws(' ', role, text) AS role_text FROM conversations",
)
def feature_concat(spark, sf):
    return table(spark, sf, "conversations", "conv_id").select(
        "conv_id", "turn", X.combine("role", "text").alias("role_text")
    )


@query(
    "label_from_name",
    "SELECT doc_id, regexp_replace(CASE WHEN doc_id % 7 = 0 THEN source || '.txt' "
    "ELSE lang || ' (' || doc_id || ').xml' END, '^(.*) \\([0-9]+\\)\\.xml$', '\\1') AS label FROM documents",
)
def label_from_name(spark, sf):
    name = F.when(F.col("doc_id") % 7 == 0, F.concat("source", F.lit(".txt"))).otherwise(
        F.concat("lang", F.lit(" ("), F.col("doc_id").cast("string"), F.lit(").xml"))
    )
    return table(spark, sf, "documents").select("doc_id", X.label_from_name(name).alias("label"))


@query("tokens", f"SELECT doc_id, array_to_string(t, ' ') AS tokens, len(t) AS n FROM (SELECT doc_id, {S.tokens()} AS t FROM documents)")
def tokens(spark, sf):
    return documents(spark, sf).select("doc_id", X.tokenize("text").alias("t")).select(
        "doc_id", F.array_join("t", " ").alias("tokens"), F.size("t").cast("bigint").alias("n")
    )


@query(
    "tokens_ws",
    f"SELECT doc_id, array_to_string(t, ' ') AS tokens, len(t) AS n FROM (SELECT doc_id, {S.words_ws('lower(text)')} AS t FROM documents)",
)
def tokens_ws(spark, sf):
    return documents(spark, sf).select("doc_id", X.tokens_ws("text").alias("t")).select(
        "doc_id", F.array_join("t", " ").alias("tokens"), F.size("t").cast("bigint").alias("n")
    )


@query(
    "stopwords",
    f"SELECT doc_id, array_to_string({S.content_tokens()}, ' ') AS tokens FROM documents",
)
def stopwords(spark, sf):
    return documents(spark, sf).select("doc_id", F.array_join(X.drop_stop_words(X.tokenize("text")), " ").alias("tokens"))


@query(
    "token_chain",
    "SELECT page_id, array_to_string(list_filter("
    + S.words_ws(f"lower(regexp_replace(replace({_html_sql()}, chr(13) || chr(10), ' '), '[^a-zA-Z0-9_]', ' ', 'g'))")
    + f", lambda t: t NOT IN ({S.STOP})), ' ') AS tokens FROM pages",
)
def token_chain(spark, sf):
    chain = X.tokenization(stop_words=fixed.STOP_WORDS)
    return table(spark, sf, "pages", "page_id").select("page_id", F.array_join(chain(F.col("html")), " ").alias("tokens"))


@query(
    "sentence_rows",
    "WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', "
    "'\\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS t FROM documents) "
    "SELECT doc_id, generate_subscripts(t, 1) AS sentence_no, unnest(t) AS sentence FROM s",
)
def sentence_rows(spark, sf):
    return T.sentence_rows(documents(spark, sf), "doc_id")


# --- stemming -----------------------------------------------------------------


def _shape(w: str) -> str:
    return (
        f"regexp_replace(translate(regexp_replace({w}, '(^|[aeiou])y', '\\1j', 'g'), 'aeiouy', 'VVVVVV'), '[^V]', 'C', 'g')"
    )


def _measure(w: str) -> str:
    return f"((length({_shape(w)}) - length(replace({_shape(w)}, 'VC', ''))) // 2)"


def _vowel(w: str) -> str:
    return f"contains({_shape(w)}, 'V')"


def _cvc(w: str) -> str:
    return f"(({_shape(w)}) LIKE '%CVC' AND NOT regexp_matches({w}, '[wxy]$'))"


def _cut(w: str, n: str) -> str:
    return f"substr({w}, 1, length({w}) - {n})"


def _suffixes(src: str, out: str, rules: dict[str, str], least: int) -> str:
    pattern = "(" + "|".join(sorted(rules, key=len, reverse=True)) + ")$"
    cases = " ".join(f"WHEN suf = '{a}' AND {_measure('rest')} > {least} THEN rest || '{b}'" for a, b in rules.items())
    return (
        f"{out}a AS (SELECT word, n, w, regexp_extract(w, '{pattern}', 1) AS suf FROM {src}), "
        f"{out}b AS (SELECT word, n, w, suf, {_cut('w', 'length(suf)')} AS rest FROM {out}a), "
        f"{out} AS (SELECT word, n, CASE {cases} ELSE w END AS w FROM {out}b)"
    )


def _stem_sql() -> str:
    repaired = (
        "CASE WHEN regexp_matches(rest, '(at|bl|iz)$') THEN rest || 'e' "
        f"WHEN length(rest) > 1 AND substr(rest, -1, 1) = substr(rest, -2, 1) AND {_shape('rest')} LIKE '%C' "
        f"AND NOT regexp_matches(rest, '[lsz]$') THEN {_cut('rest', '1')} "
        f"WHEN {_measure('rest')} = 1 AND {_cvc('rest')} THEN rest || 'e' ELSE rest END"
    )
    step4 = "(" + "|".join(sorted(fixed.PORTER_STEP4, key=len, reverse=True)) + ")$"
    return ", ".join([
        "counted AS (SELECT word, count(*) AS n FROM words GROUP BY word)",
        "s1a AS (SELECT word, n, CASE WHEN word LIKE '%sses' OR word LIKE '%ies' THEN "
        f"{_cut('word', '2')} WHEN word LIKE '%ss' THEN word WHEN word LIKE '%s' THEN {_cut('word', '1')} "
        "ELSE word END AS w FROM counted)",
        "s1x AS (SELECT word, n, w, regexp_extract(w, '(eed|ed|ing)$', 1) AS suf FROM s1a)",
        f"s1y AS (SELECT word, n, w, suf, {_cut('w', 'length(suf)')} AS rest FROM s1x)",
        f"s1b AS (SELECT word, n, CASE WHEN suf = 'eed' THEN CASE WHEN {_measure('rest')} > 0 THEN rest || 'ee' ELSE w END "
        f"WHEN suf IN ('ed', 'ing') AND {_vowel('rest')} THEN {repaired} ELSE w END AS w FROM s1y)",
        f"s1c AS (SELECT word, n, CASE WHEN w LIKE '%y' AND {_vowel(_cut('w', '1'))} THEN {_cut('w', '1')} || 'i' "
        "ELSE w END AS w FROM s1b)",
        _suffixes("s1c", "s2", fixed.PORTER_STEP2, 0),
        _suffixes("s2", "s3", fixed.PORTER_STEP3, 0),
        f"s4a AS (SELECT word, n, w, regexp_extract(w, '{step4}', 1) AS suf FROM s3)",
        f"s4b AS (SELECT word, n, w, suf, {_cut('w', 'length(suf)')} AS rest FROM s4a)",
        f"s4 AS (SELECT word, n, CASE WHEN suf <> '' AND {_measure('rest')} > 1 AND (suf <> 'ion' OR "
        "regexp_matches(rest, '[st]$')) THEN rest ELSE w END AS w FROM s4b)",
        f"s5x AS (SELECT word, n, w, {_cut('w', '1')} AS rest FROM s4)",
        f"s5 AS (SELECT word, n, CASE WHEN w LIKE '%e' AND ({_measure('rest')} > 1 OR ({_measure('rest')} = 1 AND NOT "
        f"{_cvc('rest')})) THEN rest ELSE w END AS w FROM s5x)",
        f"stems AS (SELECT word, n, CASE WHEN w LIKE '%ll' AND {_measure('w')} > 1 THEN {_cut('w', '1')} ELSE w END AS stem FROM s5)",
    ])


@query(
    "stem_counts",
    f"WITH {S.notes()}, {S.word_rows()}, {_stem_sql()} "
    "SELECT stem, CAST(sum(n) AS BIGINT) AS n, count(*) AS words FROM stems GROUP BY stem",
)
def stem_counts(spark, sf):
    return T.stem_counts(corpus_words(spark, sf))


@query(
    "token_chain_stemmed",
    "WITH pt AS (SELECT page_id, list_filter("
    + S.words_ws(f"lower(regexp_replace(replace({_html_sql()}, chr(13) || chr(10), ' '), '[^a-zA-Z0-9_]', ' ', 'g'))")
    + f", lambda t: t NOT IN ({S.STOP})) AS toks FROM pages), "
    "words AS (SELECT page_id, unnest(toks) AS word, generate_subscripts(toks, 1) AS pos FROM pt), "
    f"{_stem_sql()}, j AS (SELECT page_id, string_agg(CASE WHEN length(word) < 3 THEN word ELSE stem END, ' ' ORDER BY pos) AS tokens "
    "FROM words JOIN stems USING (word) GROUP BY page_id) "
    "SELECT p.page_id, coalesce(j.tokens, '') AS tokens FROM pages p LEFT JOIN j USING (page_id)",
)
def token_chain_stemmed(spark, sf):
    """The chain with every switch on."""
    chain = X.tokenization(stop_words=fixed.STOP_WORDS, stem=stem_word)
    return table(spark, sf, "pages", "page_id").select("page_id", F.array_join(chain(F.col("html")), " ").alias("tokens"))


@query(
    "stemmed_notes",
    f"WITH {S.notes()}, {S.word_rows()}, {_stem_sql()} "
    "SELECT n.doc_id, coalesce(j.tokens, '') AS tokens FROM documents n LEFT JOIN "
    "(SELECT doc_id, string_agg(stem, ' ' ORDER BY pos) AS tokens FROM words JOIN stems USING (word) GROUP BY doc_id) j "
    "USING (doc_id)",
)
def stemmed_notes(spark, sf):
    return T.stemmed(doc_tokens(spark, sf), "doc_id", corpus_words(spark, sf)).select("doc_id", F.array_join("tokens", " ").alias("tokens"))

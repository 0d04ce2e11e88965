"""Queries over term, word and note vectors."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from noteforge import fixed
from noteforge.functions import arrays as A
from noteforge.operators import cohort as K
from noteforge.operators import features as V
from noteforge.operators import models as M
from noteforge.operators import tokens as T
from noteforge.operators.dictionary import named
from noteforge.plans import sqltext as S
from noteforge.plans.catalog import query
from noteforge.plans.inputs import (
    DIM,
    content,
    corpus_tokens,
    corpus_words,
    doc_counts,
    doc_tokens,
    documents,
    word_vector_sql,
    word_vectors,
)
from noteforge.runtime import stage
from noteforge.sources.readers import table

VOCAB_SIZE = 1_000_000
DIMENSIONS = 200  # of the fitted word vectors

NOTES = S.notes()
WORDS = f"{NOTES}, {S.word_rows()}"
COUNTS = f"{WORDS}, tf AS (SELECT doc_id, word, count(*) AS n FROM words GROUP BY doc_id, word)"


def _vocab_cte(size: int) -> str:
    return (
        f"{WORDS}, vocab AS (SELECT word, n, row_number() OVER (ORDER BY n DESC, word) AS id FROM "
        f"(SELECT word, count(*) AS n FROM words GROUP BY word) QUALIFY id <= {size})"
    )


@query(
    "vocab",
    f"WITH {_vocab_cte(999_999)} SELECT word, n, id FROM vocab UNION ALL SELECT '{fixed.RARE_WORD}', -1, 0",
)
def vocab(spark, sf):
    return T.vocabulary(corpus_words(spark, sf))


def _vocab(spark, sf):
    return stage(T.vocabulary(corpus_words(spark, sf), VOCAB_SIZE))


IDS = (
    f"{_vocab_cte(VOCAB_SIZE - 1)}, seq AS (SELECT n.doc_id, coalesce(s.ids, []) AS ids FROM notes n LEFT JOIN "
    "(SELECT doc_id, list(coalesce(v.id, 0) ORDER BY pos) AS ids FROM words w LEFT JOIN vocab v ON w.word = v.word GROUP BY doc_id) s "
    "ON n.doc_id = s.doc_id)"
)


def _ids(spark, sf):
    return T.to_ids(doc_tokens(spark, sf), "doc_id", _vocab(spark, sf), staged=True)


def _joined(ids):
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), " ")


@query("token_ids", f"WITH {IDS} SELECT doc_id, array_to_string(ids, ' ') AS ids FROM seq")
def token_ids(spark, sf):
    return _ids(spark, sf).select("doc_id", _joined(F.col("ids")).alias("ids"))


@query(
    "pad_right",
    f"WITH {IDS} SELECT doc_id, array_to_string(list_resize(ids[1:300], 300, 0), ' ') AS ids FROM seq",
)
def pad_right(spark, sf):
    return _ids(spark, sf).select("doc_id", _joined(A.pad_right("ids", 300)).alias("ids"))


@query(
    "pad_left",
    f"WITH {IDS} SELECT doc_id, array_to_string(list_concat(list_resize([]::BIGINT[], greatest(300 - len(ids), 0), 0), "
    "CASE WHEN len(ids) > 300 THEN ids[-300:] ELSE ids END), ' ') AS ids FROM seq",
)
def pad_left(spark, sf):
    return _ids(spark, sf).select("doc_id", _joined(A.pad_left("ids", 300)).alias("ids"))


@query("max_len", f"WITH {IDS} SELECT max(len(ids)) AS max_len FROM seq")
def max_len(spark, sf):
    return T.longest(_ids(spark, sf))


@query(
    "ids_to_words",
    f"WITH {_vocab_cte(VOCAB_SIZE - 1)} SELECT doc_id, string_agg(coalesce(v.word, '{fixed.RARE_WORD}'), ' ' ORDER BY pos) AS words "
    "FROM words w LEFT JOIN vocab v ON w.word = v.word GROUP BY doc_id",
)
def ids_to_words(spark, sf):
    notes = doc_tokens(spark, sf)
    words = _vocab(spark, sf)
    named = T.to_words(T.to_ids(notes, "doc_id", words, staged=True), "doc_id", words)
    return named.select("doc_id", F.array_join("words", " ").alias("words"))


@query("term_counts", f"WITH {COUNTS} SELECT doc_id, word, n FROM tf")
def term_counts(spark, sf):
    words = T.text_words(documents(spark, sf), keep=("doc_id",))
    return words.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))


@query("doc_freq", f"WITH {COUNTS} SELECT word, count(*) AS df FROM tf GROUP BY word")
def doc_freq(spark, sf):
    return T.document_frequency(corpus_tokens(spark, sf))


@query(
    "term_counts_fixed",
    f"WITH {WORDS}, bench AS (SELECT unnest({S.content_tokens()}) AS word FROM benchmark), "
    "vocab AS (SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) AS id FROM bench GROUP BY word) "
    "SELECT doc_id, id, count(*) AS n FROM words JOIN vocab USING (word) GROUP BY doc_id, id",
)
def term_counts_fixed(spark, sf):
    """Documents counted with a dictionary stored from another table."""
    bench = table(spark, sf, "benchmark").select(F.explode(content(F.col("text"))).alias("word"))
    return T.fixed_term_counts(doc_tokens(spark, sf), "doc_id", T.vocabulary(bench))


TFIDF = (
    f"{COUNTS}, df AS (SELECT word, count(*) AS df FROM tf GROUP BY word), "
    "raw AS (SELECT doc_id, word, (ln(n) + 1.0) * (ln(((SELECT count(*) FROM documents) + 1.0) / (df + 1.0)) + 1.0) AS w "
    "FROM tf JOIN df USING (word)), norms AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM raw GROUP BY doc_id), "
    "weights AS (SELECT doc_id, word, w / norm AS weight FROM raw JOIN norms USING (doc_id))"
)


def _tfidf(spark, sf):
    frequencies = T.document_frequency(corpus_tokens(spark, sf))
    n_notes = table(spark, sf, "documents").count()  # from the file footers
    return V.tfidf(doc_counts(spark, sf), "doc_id", frequencies, n_notes)


@query("tfidf", f"WITH {TFIDF} SELECT doc_id, word, round(weight, 6) AS weight FROM weights")
def tfidf(spark, sf):
    return _tfidf(spark, sf).withColumn("weight", F.round("weight", 6))


@query(
    "top_terms",
    f"WITH {TFIDF}, t AS (SELECT lang, word, round(sum(weight), 6) AS weight FROM weights JOIN documents USING (doc_id) GROUP BY lang, word) "
    "SELECT lang, word, weight, row_number() OVER (PARTITION BY lang ORDER BY weight DESC, word) AS place FROM t QUALIFY place <= 10",
)
def top_terms(spark, sf):
    """The ten heaviest tf-idf terms of each language."""
    weights = _tfidf(spark, sf)
    langs = table(spark, sf, "documents").select("doc_id", "lang")
    terms = weights.join(langs, "doc_id").groupBy("lang", "word").agg(F.round(F.sum("weight"), 6).alias("weight"))
    # each task keeps its own first ten per language before anything is shuffled
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("weight"), "word"))
    return terms.withColumn("place", place.cast("bigint")).where(F.col("place") <= 10)


# --- vectors ---------------------------------------------------------------------

VEC_COLS = ", ".join(f"{e} AS v{i}" for i, e in enumerate(word_vector_sql()))
VECTORS = f"vectors AS (SELECT word, {VEC_COLS} FROM (SELECT DISTINCT word FROM words) WHERE length(word) % 2 = 0)"
W_ATT = [0.31, -0.27, 0.53, 0.11, -0.43, 0.71, -0.19, 0.37]
B_ATT = 0.05
W_CTX = [[((i * 7 + j * 3) % 13 - 6) / 10.0 for j in range(4)] for i in range(DIM)]
B_CTX = [0.1, -0.2, 0.05, 0.3]
U_CTX = [0.9, -0.6, 0.4, 0.8]


def _dot_sql(weights) -> str:
    return "(" + " + ".join(f"v{i} * {w}::DOUBLE" for i, w in enumerate(weights)) + ")"


ATT_SQL = f"exp(tanh({_dot_sql(W_ATT)} + {B_ATT}::DOUBLE))"
CTX_SQL = "exp(" + " + ".join(
    f"tanh({_dot_sql([row[j] for row in W_CTX])} + {B_CTX[j]}::DOUBLE) * {u}::DOUBLE" for j, u in enumerate(U_CTX)
) + ")"


def _pool_sql(weight: str, source: str, epsilon: float = 0.0) -> str:
    sums = ", ".join(f"sum({weight} * v{i}) / (sum({weight}) + {epsilon}::DOUBLE) AS p{i}" for i in range(DIM))
    picks = ", ".join(f"p{i}" for i in range(DIM))
    return (
        f"pooled AS (SELECT doc_id, {sums} FROM {source} GROUP BY doc_id) "
        f"SELECT doc_id, unnest(range(1, {DIM + 1})) AS dim, round(unnest([{picks}]), 6) AS value FROM pooled"
    )


def _long(pooled):
    return V.matrix_rows(pooled, "doc_id").withColumn("value", F.round("value", 6))


@query(
    "vocab_vectors",
    f"WITH {_vocab_cte(VOCAB_SIZE - 1)}, {VECTORS} SELECT b.word, b.id, CAST(x.word IS NOT NULL AS BIGINT) AS known, "
    + "round(" + " + ".join(f"coalesce(v{i}, 0) * {i + 1}" for i in range(DIM)) + ", 6) AS checksum "
    f"FROM (SELECT word, id FROM vocab UNION ALL SELECT '{fixed.RARE_WORD}', 0) b LEFT JOIN vectors x USING (word)",
)
def vocab_vectors(spark, sf):
    joined = V.vocab_vectors(_vocab(spark, sf), word_vectors(corpus_words(spark, sf)), DIM)
    total = F.aggregate(
        F.transform("vec", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x
    )
    return joined.select("word", "id", "known", F.round(total, 6).alias("checksum"))


@query(
    "vector_coverage",
    f"WITH {_vocab_cte(VOCAB_SIZE - 1)}, b AS (SELECT word FROM vocab UNION ALL SELECT '{fixed.RARE_WORD}') "
    "SELECT count(*) AS words, CAST(sum(CASE WHEN length(word) % 2 = 0 AND word <> 'RARE' THEN 1 ELSE 0 END) AS BIGINT) AS known, "
    "round(avg(CASE WHEN length(word) % 2 = 0 AND word <> 'RARE' THEN 1 ELSE 0 END), 6) AS coverage FROM b",
)
def vector_coverage(spark, sf):
    joined = V.vocab_vectors(_vocab(spark, sf), word_vectors(corpus_words(spark, sf)), DIM)
    return V.vector_coverage(joined).withColumn("coverage", F.round("coverage", 6))


@query("doc_vectors_mean", f"WITH {COUNTS}, {VECTORS}, rows_ AS (SELECT * FROM tf JOIN vectors USING (word)), {_pool_sql('n', 'rows_')}")
def doc_vectors_mean(spark, sf):
    return _long(V.pooled_vectors(doc_counts(spark, sf), "doc_id", word_vectors(corpus_words(spark, sf)), DIM))


@query("doc_vectors_weighted", f"WITH {TFIDF}, {VECTORS}, rows_ AS (SELECT * FROM weights JOIN vectors USING (word)), {_pool_sql('weight', 'rows_')}")
def doc_vectors_weighted(spark, sf):
    weights = _tfidf(spark, sf)
    return _long(V.weighted_vectors(weights, "doc_id", word_vectors(corpus_words(spark, sf)), DIM))


@query(
    "attention_pool",
    f"WITH {COUNTS}, {VECTORS}, rows_ AS (SELECT *, n * {ATT_SQL} AS a FROM tf JOIN vectors USING (word)), {_pool_sql('a', 'rows_', fixed.EPSILON)}",
)
def attention_pool(spark, sf):
    score = V.attention_score(F.col("vec"), W_ATT, B_ATT)
    return _long(V.attention_pool(doc_counts(spark, sf), "doc_id", word_vectors(corpus_words(spark, sf)), score, DIM))


@query(
    "attention_context",
    f"WITH {COUNTS}, {VECTORS}, rows_ AS (SELECT *, n * {CTX_SQL} AS a FROM tf JOIN vectors USING (word)), {_pool_sql('a', 'rows_', fixed.EPSILON)}",
)
def attention_context(spark, sf):
    score = V.context_score(F.col("vec"), W_CTX, B_CTX, U_CTX)
    return _long(V.attention_pool(doc_counts(spark, sf), "doc_id", word_vectors(corpus_words(spark, sf)), score, DIM))


@query(
    "attention_weights",
    f"WITH {WORDS}, {VECTORS}, s AS (SELECT doc_id, pos, word, {ATT_SQL} AS score FROM words JOIN vectors USING (word)) "
    f"SELECT doc_id, pos, word, round(score / (sum(score) OVER (PARTITION BY doc_id) + {fixed.EPSILON}::DOUBLE), 6) AS weight FROM s",
)
def attention_weights(spark, sf):
    notes = doc_tokens(spark, sf)
    score = V.attention_score(F.col("vec"), W_ATT, B_ATT)
    rows = V.attention_weights(notes, "doc_id", word_vectors(corpus_words(spark, sf)), score)
    return rows.withColumn("weight", F.round("weight", 6))


@query(
    "top_tokens",
    f"WITH {WORDS}, {VECTORS}, s AS (SELECT doc_id, pos, word, round({ATT_SQL}, 9) AS score FROM words JOIN vectors USING (word)) "
    "SELECT doc_id, place, pos, word, round(weight, 6) AS weight FROM (SELECT doc_id, pos, word, "
    f"score / (sum(score) OVER (PARTITION BY doc_id) + {fixed.EPSILON}::DOUBLE) AS weight, "
    "row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS place FROM s) WHERE place <= 20",
)
def top_tokens(spark, sf):
    notes = doc_tokens(spark, sf)
    # nine digits, so that ties are the same on every machine
    score = F.round(V.attention_score(F.col("vec"), W_ATT, B_ATT), 9)
    rows = V.top_tokens(notes, "doc_id", word_vectors(corpus_words(spark, sf)), score)
    return rows.withColumn("weight", F.round("weight", 6))


@query(
    "chi2_terms",
    f"WITH {WORDS}, obs AS (SELECT word, lang, count(*) AS o FROM words GROUP BY word, lang), "
    "tot AS (SELECT word, sum(o) AS t FROM obs GROUP BY word), "
    "share AS (SELECT lang, count(*) * 1.0::DOUBLE / sum(count(*)) OVER () AS p FROM documents WHERE lang IS NOT NULL GROUP BY lang) "
    "SELECT t.word, round(sum((coalesce(o.o, 0) - t.t * s.p) * (coalesce(o.o, 0) - t.t * s.p) / (t.t * s.p)), 5) AS chi2 "
    "FROM tot t CROSS JOIN share s LEFT JOIN obs o ON o.word = t.word AND o.lang = s.lang GROUP BY t.word",
)
def chi2_terms(spark, sf):
    table_, _ = _chi2(spark, sf)
    return table_.withColumn("chi2", F.round("chi2", 5))


def _chi2(spark, sf):
    docs = documents(spark, sf)
    sizes = {r["lang"]: r["n"] for r in K.value_counts(docs, "lang").collect()}  # one row per class
    classes = sorted(sizes)
    words = T.text_words(docs, keep=("lang",))
    counts = words.groupBy("word", "lang").agg(F.count(F.lit(1)).alias("n"))
    return V.chi2_terms(counts, "lang", classes, sizes), len(classes)


@query("chi2_selected")
def chi2_selected(spark, sf):
    """Terms kept by the chi-square test at a false discovery rate of 0.05."""
    stats, classes = _chi2(spark, sf)
    scored = stage(stats.withColumn("p_value", V.chi2_p_value(F.col("chi2"), classes - 1)))
    return V.select_fdr(scored)


# --- fitted vectors -----------------------------------------------------------------


def _word2vec(spark, sf, dim: int = DIMENSIONS):
    notes = corpus_tokens(spark, sf)
    return notes, M.word2vec(dim=dim).fit(notes)


@query("word2vec")
def word2vec(spark, sf):
    """Skip-gram word vectors in wide form."""
    _, model = _word2vec(spark, sf)
    vectors = model.getVectors().select("word", M.vector_to_array("vector").alias("vec"))
    return V.matrix_wide(vectors, "word", DIMENSIONS)


@query("doc_vectors")
def doc_vectors(spark, sf):
    """Mean of the fitted word vectors per note, in long form."""
    notes, model = _word2vec(spark, sf)
    pooled = model.transform(notes).select("doc_id", M.vector_to_array("vec").alias("vec"))
    return V.matrix_rows(pooled, "doc_id")


@query("hashing_tf")
def hashing_tf(spark, sf):
    """Hashed term counts, one row per occupied slot."""
    notes = corpus_tokens(spark, sf)
    hashed = M.hashing_stages(width=1 << 16)[0].transform(notes)
    return hashed.select("doc_id", F.unwrap_udt("features").alias("v")).select(
        "doc_id", F.explode(F.arrays_zip(F.col("v.indices").alias("slot"), F.col("v.values").alias("n"))).alias("x")
    ).select("doc_id", F.col("x.slot").cast("bigint").alias("slot"), F.col("x.n").cast("bigint").alias("n"))


def _vectorised(spark, sf, weighting: str):
    """A dictionary fitted on the documents, and their sparse vectors in long form."""
    notes = documents(spark, sf).select("doc_id", "text")
    fitted = M.featuriser(weighting, "text").fit(notes)
    rows = fitted.transform(notes, "doc_id").select("doc_id", F.unwrap_udt("features").alias("v")).select(
        "doc_id", F.explode(F.arrays_zip(F.col("v.indices").alias("id"), F.col("v.values").alias("w"))).alias("x")
    )
    return fitted.dictionary, rows.select("doc_id", F.col("x.id").alias("id"), F.col("x.w").alias("w"))


IDS_FROM_0 = f"{COUNTS}, ids AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) - 1 AS id FROM (SELECT word, sum(n) AS n FROM tf GROUP BY word))"


@query("vectorised_counts", f"WITH {COUNTS} SELECT doc_id, word, n FROM tf")
def vectorised_counts(spark, sf):
    """Sparse count vectors, turned back into words."""
    dictionary, rows = _vectorised(spark, sf, "freq")
    return named(rows, dictionary, ["doc_id", "id"]).select("doc_id", "word", F.col("w").cast("bigint").alias("n"))


@query("vector_counts", f"WITH {IDS_FROM_0} SELECT doc_id, id, n FROM tf JOIN ids USING (word)")
def vector_counts(spark, sf):
    """Sparse count vectors: word numbers and counts."""
    _, rows = _vectorised(spark, sf, "freq")
    return rows.select("doc_id", F.col("id").cast("bigint").alias("id"), F.col("w").cast("bigint").alias("n"))


@query(
    "vector_tfidf",
    f"WITH {TFIDF}, ids AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) - 1 AS id FROM (SELECT word, sum(n) AS n FROM tf GROUP BY word)) "
    "SELECT doc_id, id, round(weight, 6) AS weight FROM weights JOIN ids USING (word)",
)
def vector_tfidf(spark, sf):
    """Sparse tf-idf vectors of unit length: word numbers and weights."""
    _, rows = _vectorised(spark, sf, "tfidf")
    return rows.select("doc_id", F.col("id").cast("bigint").alias("id"), F.round("w", 6).alias("weight"))

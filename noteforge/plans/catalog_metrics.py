"""Queries over prediction tables; the predictions come from closed-form classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteforge import fixed
from noteforge.functions.arrays import argmax
from noteforge.operators import bayes
from noteforge.operators import metrics as E
from noteforge.operators import splits
from noteforge.plans import sqltext as S
from noteforge.plans.catalog import query
from noteforge.plans.inputs import labelled_tokens, rule_predictions
from noteforge.plans.sqltext import CUES
from noteforge.runtime import stage_table
from noteforge.sources.readers import table

RULE = S.rule_predictions()


def _report_sql(preds: str, by: str = "") -> str:
    """CTE ``report`` from ``(by, truth, pred)`` rows."""
    b = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return (
        f"cls AS (SELECT DISTINCT {b}truth AS class FROM {preds} UNION SELECT DISTINCT {b}pred FROM {preds}), "
        f"cnt AS (SELECT {''.join(f'c.{x.strip()}, ' for x in by.split(',')) if by else ''}class, "
        "count(*) FILTER (p.truth = class) AS support, count(*) FILTER (p.pred = class) AS predicted, "
        "count(*) FILTER (p.truth = class AND p.pred = class) AS hits, count(*) AS total FROM cls c JOIN "
        f"{preds} p ON " + (" AND ".join(f"c.{x.strip()} = p.{x.strip()}" for x in by.split(",")) if by else "TRUE")
        + " GROUP BY ALL), "
        f"pr AS (SELECT {b}class, support, predicted, hits, total, "
        "CASE WHEN predicted > 0 THEN hits / predicted ELSE 0.0 END AS precision, "
        "CASE WHEN support > 0 THEN hits / support ELSE 0.0 END AS recall, "
        "CASE WHEN total > support THEN (predicted - hits) / (total - support) ELSE 0.0 END AS fpr FROM cnt), "
        "report AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1, "
        f"(recall + 1 - fpr) / 2 AS auc FROM pr)"
    )


def _weighted_sql(by: str = "") -> str:
    b = f"{by}, " if by else ""
    cols = ", ".join(f"sum({c} * support) / sum(support) AS {c}" for c in ("precision", "recall", "f1", "auc"))
    return f"SELECT {b}sum(hits) / sum(support) AS accuracy, {cols} FROM report" + (f" GROUP BY {by}" if by else "")


def _rounded(names) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def _round(df, names):
    return df.withColumns({n: F.round(n, 6) for n in names})


SCORES = ["accuracy", "precision", "recall", "f1", "auc"]


@query("metrics", f"WITH {RULE}, {_report_sql('preds')}, w AS ({_weighted_sql()}) SELECT {_rounded(SCORES)} FROM w")
def metrics(spark, sf):
    return _round(E.weighted_scores(rule_predictions(spark, sf)), SCORES)


@query(
    "class_report",
    f"WITH {RULE}, {_report_sql('preds')} SELECT class, support, predicted, hits, {_rounded(SCORES[1:4])} FROM report",
)
def class_report(spark, sf):
    report = E.class_report(rule_predictions(spark, sf))
    return _round(report, SCORES[1:4]).drop("auc")


@query("auc_hard", f"WITH {RULE}, {_report_sql('preds')} SELECT class, support, round(auc, 6) AS auc FROM report")
def auc_hard(spark, sf):
    return E.class_report(rule_predictions(spark, sf)).select("class", "support", F.round("auc", 6).alias("auc"))


@query("auc_macro", f"WITH {RULE}, {_report_sql('preds')} SELECT round(avg(auc), 6) AS auc FROM report WHERE support > 0")
def auc_macro(spark, sf):
    """Unweighted mean over the classes that occur."""
    report = E.class_report(rule_predictions(spark, sf)).where("support > 0")
    return report.agg(F.round(F.avg("auc"), 6).alias("auc"))


@query(
    "metrics_binary",
    f"WITH {RULE}, {_report_sql('preds')} SELECT {_rounded(SCORES[1:4])} FROM report WHERE class = 'en'",
)
def metrics_binary(spark, sf):
    return _round(E.binary_scores(rule_predictions(spark, sf), "en"), SCORES[1:4])


LONG = "scored AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS class, round(p_{c}, 9) AS score, CAST(truth = '{c}' AS BIGINT) AS hit FROM preds" for c in CUES
) + ")"
AUC = (
    f"{LONG}, ranked AS (SELECT *, rank() OVER (PARTITION BY class ORDER BY score) + "
    "(count(*) OVER (PARTITION BY class, score) - 1) / 2.0::DOUBLE AS r FROM scored), "
    "aucs AS (SELECT class, sum(hit) AS positives, sum(1 - hit) AS negatives, "
    "(sum(r) FILTER (hit = 1) - sum(hit) * (sum(hit) + 1) / 2.0::DOUBLE) / (sum(hit) * 1.0::DOUBLE * sum(1 - hit)) AS auc FROM ranked GROUP BY class)"
)


def _scored(spark, sf):
    long = E.class_scores_long(rule_predictions(spark, sf), list(CUES))
    return long.withColumn("score", F.round("score", 9))


@query(
    "auc_prob",
    f"WITH {RULE}, {AUC} SELECT class, CAST(positives AS BIGINT) AS positives, CAST(negatives AS BIGINT) AS negatives, round(auc, 6) AS auc FROM aucs",
)
def auc_prob(spark, sf):
    return E.auc_by_class(_scored(spark, sf)).withColumn("auc", F.round("auc", 6))


@query("auc_weighted", f"WITH {RULE}, {AUC} SELECT round(sum(auc * positives) / sum(positives), 6) AS auc FROM aucs")
def auc_weighted(spark, sf):
    return E.weighted_auc(_scored(spark, sf)).withColumn("auc", F.round("auc", 6))


# A score that leaves [0, 1] on both sides, so the clipping matters.
FB_SCORE_SQL = "(n_chars % 23) / 15.0::DOUBLE - 0.2::DOUBLE"


def _fbeta_sql(beta: float) -> str:
    def clipped(x: str) -> str:
        return f"sum(round(least(greatest({x}, 0.0), 1.0)))"

    e = f"{fixed.EPSILON}::DOUBLE"
    bb = beta * beta
    return (
        f"s AS (SELECT {clipped('toxic * score')} AS both_, {clipped('score')} AS said, {clipped('toxic::DOUBLE')} AS had FROM x), "
        f"pr AS (SELECT both_ / (said + {e}) AS p, both_ / (had + {e}) AS r, had FROM s) "
        f"SELECT round(p, 6) AS precision, round(r, 6) AS recall, "
        f"round(CASE WHEN had = 0 THEN 0.0 ELSE {1 + bb}::DOUBLE * (p * r) / ({bb}::DOUBLE * p + r + {e}) END, 6) AS fbeta FROM pr"
    )


@query(
    "fbeta",
    f"WITH x AS (SELECT l.toxic, {FB_SCORE_SQL} AS score FROM labels l JOIN documents d USING (doc_id)), {_fbeta_sql(2.0)}",
)
def fbeta(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", ((F.col("n_chars") % 23) / 15.0 - 0.2).alias("score"))
    rows = table(spark, sf, "labels").select("doc_id", "toxic").join(docs, "doc_id")
    out = E.fbeta(rows, F.col("toxic").cast("double"), F.col("score"), beta=2.0)
    return _round(out, ["precision", "recall", "fbeta"])


@query(
    "argmax_class",
    f"WITH {RULE} SELECT doc_id, pred, round(greatest({', '.join(f'p_{c}' for c in CUES)}), 6) AS share FROM preds",
)
def argmax_class(spark, sf):
    preds = rule_predictions(spark, sf)
    names = F.array(*[F.lit(c) for c in CUES])
    return preds.select(
        "doc_id", names[argmax("probs").cast("int")].alias("pred"), F.round(F.array_max("probs"), 6).alias("share")
    )


FOLDED = (
    "fold_preds AS (SELECT rep, (row_number() OVER (PARTITION BY rep, lang ORDER BY md5(doc_id || '|' || rep), doc_id) - 1) % 5 AS k, "
    "truth, pred FROM (SELECT doc_id, lang FROM documents) JOIN preds USING (doc_id), (SELECT unnest([1, 2]::BIGINT[]) AS rep))"
)


@query(
    "best_run",
    f"WITH {RULE}, {FOLDED}, {_report_sql('fold_preds', 'rep, k')}, w AS ({_weighted_sql('rep, k')}) "
    f"SELECT rep, k, {_rounded(SCORES)} FROM w ORDER BY round(auc, 6) DESC, rep, k LIMIT 1",
)
def best_run(spark, sf):
    """The best of 2 x 5 folds by hard-label AUC."""
    preds = rule_predictions(spark, sf)
    folds = splits.stratified_folds(preds, "doc_id", "true", 5, 2).withColumnRenamed("fold", "k")
    scores = _round(E.weighted_scores(folds, by=["rep", "k"]), SCORES)
    return E.best_run(scores)


NB = (
    f"{S.FOLDS}, {S.notes()}, tr AS (SELECT n.doc_id, n.lang, toks FROM notes n JOIN folds f USING (doc_id) WHERE fold <> 0), "
    "te AS (SELECT n.doc_id, toks FROM notes n JOIN folds f USING (doc_id) WHERE fold = 0), "
    "cw AS (SELECT lang, unnest(toks) AS word FROM tr), lik AS (SELECT word, lang, count(*) AS n FROM cw GROUP BY ALL), "
    "voc AS (SELECT DISTINCT word FROM lik), cls AS (SELECT t.lang, t.docs, coalesce(w.words, 0) AS words FROM "
    "(SELECT lang, count(*) AS docs FROM tr GROUP BY lang) t LEFT JOIN (SELECT lang, sum(n) AS words FROM lik GROUP BY lang) w USING (lang)), "
    "tw AS (SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS word FROM te) JOIN voc USING (word) GROUP BY ALL), "
    "full_ AS (SELECT tw.doc_id, c.lang, sum(tf * ln((coalesce(l.n, 0) + 1.0::DOUBLE) / (c.words + (SELECT count(*) FROM voc)))) AS ll "
    "FROM tw CROSS JOIN cls c LEFT JOIN lik l ON l.word = tw.word AND l.lang = c.lang GROUP BY ALL), "
    "nb AS (SELECT te.doc_id, c.lang, ln(c.docs * 1.0::DOUBLE / (SELECT sum(docs) FROM cls)) + coalesce(f.ll, 0) AS score "
    "FROM te CROSS JOIN cls c LEFT JOIN full_ f ON f.doc_id = te.doc_id AND f.lang = c.lang)"
)


def _nb(spark, sf):
    folds = splits.stratified_folds(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", "lang", 5)
    notes = labelled_tokens(spark, sf).join(folds.select("doc_id", "fold"), "doc_id")
    notes = stage_table(notes, "folded")
    return bayes.nb_scores(notes.where("fold <> 0"), notes.where("fold = 0"), "doc_id", "lang")


@query("nb_scores", f"WITH {NB} SELECT doc_id, lang AS class, round(score, 4) AS score FROM nb")
def nb_scores(spark, sf):
    return _nb(spark, sf).withColumn("score", F.round("score", 4))


@query(
    "nb_predict",
    f"WITH {NB} SELECT doc_id, lang AS pred, round(score, 4) AS score FROM nb QUALIFY row_number() OVER "
    "(PARTITION BY doc_id ORDER BY round(score, 4) DESC, lang) = 1",
)
def nb_predict(spark, sf):
    return bayes.nb_predict(nb_scores(spark, sf), "doc_id")

"""Queries that fit models: predictions, scores, reports."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import LDA
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from noteforge.operators import models as M
from noteforge.operators import paragraphs, selection, solver, splits
from noteforge.operators.attention import Shape, fit_attention
from noteforge.operators.dictionary import named, term_rows
from noteforge.operators.features import matrix_rows
from noteforge.operators.metrics import weighted_scores
from noteforge.plans import jobs
from noteforge.plans.catalog import query
from noteforge.plans.inputs import DIM, corpus_tokens, corpus_words, doc_counts, documents, word_vectors
from noteforge.plans.sqltext import CUES, content_tokens
from noteforge.plans.sqltext import notes as notes_sql
from noteforge.runtime import scratch_path, stage_table
from noteforge.sources.readers import table
from noteforge.sources.writers import save_bundle
from noteforge.streaming.score import note_stream, score_stream, scored_notes


def _texts(spark, sf):
    return documents(spark, sf).select("doc_id", F.col("text").alias("bow"), "lang")


def _halves(df, key, label):
    marked = splits.stratified_split(df, key, label)
    return marked.where("in_train").drop("in_train"), marked.where("NOT in_train").drop("in_train")


def _text_fit(code: str, weighting: str = "freq", balanced: bool = False, **options):
    """Fit on 70 % of the documents, predict the language of the rest."""

    def run(spark, sf):
        train, test = _halves(_texts(spark, sf), "doc_id", "lang")
        spec = M.Spec("bow", code, weighting, balanced)
        bundle = M.fit_bundle(train, spec, "doc_id", "lang", **options)
        return _predictions(bundle.transform(test), "doc_id", "lang", bundle.labels)

    return run


def _predictions(scored, key, label, labels):
    return scored.select(
        key, F.col(label).alias("true"), F.col("pred_class").alias("pred"),
        *[F.col(M.PROBS)[i].alias(f"p_{x}") for i, x in enumerate(labels)],
    )


def _vectors(spark, sf):
    """The embedding table as ``(vec_id, features, label_idx)``."""
    return table(spark, sf, "embeddings", "vec_id").select(
        "vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias(M.FEATURES),
        F.col("label").cast("double").alias(M.LABEL),
    )


def _vector_fit(code: str, **options):
    """Fit on 70 % of the vectors, predict the class of the rest."""

    def run(spark, sf):
        train, test = _halves(_vectors(spark, sf), "vec_id", M.LABEL)
        classes = int(train.agg(F.max(M.LABEL)).first()[0]) + 1
        fitted = M.fit_classifier(train, code, classes, "vec_id", **options)
        return fitted.transform(test, "vec_id").select(
            "vec_id", F.col(M.LABEL).alias("true"), F.col(M.PREDICTION).alias("pred"),
            F.array_max(M.PROBS).alias("share"),
        )

    return run


query("fit_l1")(_text_fit("l1"))
query("fit_l2")(_text_fit("l2", "tfidf"))
query("fit_l2_balanced")(_text_fit("l2", "tfidf", balanced=True))


def _bayes_sql(train: str, test: str, key: str) -> str:
    """CTE ``shares``: class shares of multinomial naive Bayes, smoothed counts and priors.

    ``train`` gives lang and toks, ``test`` the key and toks.
    """
    return f"""
tr AS ({train}), te AS ({test}),
lik AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(toks) AS word FROM tr) GROUP BY lang, word),
voc AS (SELECT DISTINCT word FROM lik),
cls AS (
  SELECT lang, docs, coalesce(words, 0) AS words FROM (SELECT lang, count(*) AS docs FROM tr GROUP BY lang)
  LEFT JOIN (SELECT lang, sum(n) AS words FROM lik GROUP BY lang) USING (lang)
),
tw AS (SELECT {key}, word, count(*) AS tf FROM (SELECT {key}, unnest(toks) AS word FROM te) JOIN voc USING (word) GROUP BY {key}, word),
ll AS (
  SELECT tw.{key}, cls.lang, sum(tf * ln((coalesce(lik.n, 0) + 1.0::DOUBLE) / (cls.words + (SELECT count(*) FROM voc)))) AS ll
  FROM tw CROSS JOIN cls LEFT JOIN lik ON lik.word = tw.word AND lik.lang = cls.lang GROUP BY tw.{key}, cls.lang
),
sc AS (
  SELECT te.{key}, cls.lang, coalesce(ll.ll, 0)
         + ln((cls.docs + 1.0::DOUBLE) / (SELECT sum(docs) + count(*) FROM cls)) AS s
  FROM te CROSS JOIN cls LEFT JOIN ll ON ll.{key} = te.{key} AND ll.lang = cls.lang
),
shares AS (
  SELECT {key}, lang, e / sum(e) OVER (PARTITION BY {key}) AS p
  FROM (SELECT *, exp(s - max(s) OVER (PARTITION BY {key})) AS e FROM sc)
)"""


def _wide(key: str, prefix: str, pred: str) -> str:
    columns = ", ".join(f"round(max(p) FILTER (lang = '{c}'), 4) AS {prefix}{c}" for c in sorted(CUES))
    return f"SELECT {key}, arg_max(lang, p) AS {pred}, {columns} FROM shares GROUP BY {key}"


HALVES = (
    "halves AS (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '|42'), doc_id) <= "
    "round(0.7 * count(*) OVER (PARTITION BY lang)) AS in_train FROM documents)"
)


@query(
    "fit_nb",
    f"WITH {HALVES}, {notes_sql()}, "
    + _bayes_sql(
        "SELECT lang, toks FROM notes JOIN halves USING (doc_id) WHERE in_train",
        "SELECT doc_id, toks FROM notes JOIN halves USING (doc_id) WHERE NOT in_train", "doc_id",
    )
    + f", w AS ({_wide('doc_id', 'p_', 'pred')}) SELECT d.lang AS true, w.* FROM w JOIN documents d USING (doc_id)",
)
def fit_nb(spark, sf):
    """Naive Bayes fitted by the library, held against its closed form."""
    return _rounded(_text_fit("nb")(spark, sf))


def _rounded(df):
    return df.select(*[F.round(c, 4).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


query("fit_svmlin")(_text_fit("svmlin", "tfidf"))
query("fit_svmsgd")(_text_fit("svmsgd", "tfidf"))
query("fit_svmrbf")(_vector_fit("svmrbf"))
query("fit_svmrbf_text")(_text_fit("svmrbf", "tfidf", gamma=1.0, fourier=512))
query("fit_rf")(_vector_fit("rf"))
query("fit_adaboost")(_vector_fit("adaboost"))
query("fit_mlp")(_vector_fit("mlp"))


@query("fit_embed_mlp")
def fit_embed_mlp(spark, sf):
    """Word vectors, pooled per note, into a small network."""
    train, test = _halves(_texts(spark, sf), "doc_id", "lang")
    bundle = M.fit_bundle(train, M.Spec("bow", "dnn", "pv"), "doc_id", "lang",
                          feature_options={"dim": 200})
    return _predictions(bundle.transform(test), "doc_id", "lang", bundle.labels)


@query("doc_vectors_pv")
def doc_vectors_pv(spark, sf):
    """Paragraph vectors of the documents, trained on rotating blocks, in long form."""
    _, vectors = paragraphs.fit(corpus_tokens(spark, sf), "doc_id", paragraphs.Settings(dim=50, passes=4))
    return matrix_rows(vectors.withColumnRenamed("_key", "doc_id"), "doc_id")


def _attention(spark, sf):
    """A pool trained on 70 % of the documents against the language, judged on the rest; notes' counts, labels and word vectors."""
    labels = M.label_indexer("lang").fit(_texts(spark, sf).where("lang IS NOT NULL"))
    named = labels.setHandleInvalid("skip").transform(_texts(spark, sf)).select("doc_id", F.col(M.LABEL).cast("int").alias("y"))
    marked = splits.stratified_split(named, "doc_id", "y")
    counts, vectors = doc_counts(spark, sf), word_vectors(corpus_words(spark, sf))
    shape = Shape(DIM, len(labels.labels), contexts=4)
    pool, state = fit_attention(counts, "doc_id", named, vectors, shape, check=marked.where("NOT in_train"), steps=15)
    return pool, state, counts, vectors, marked


@query("attention_fit")
def attention_fit(spark, sf):
    """Documents pooled by trained attention, in long form."""
    pool, _, counts, vectors, _ = _attention(spark, sf)
    return matrix_rows(pool.pool(counts, "doc_id", vectors), "doc_id")


@query("fit_attention_mlp")
def fit_attention_mlp(spark, sf):
    """Trained attention pools the notes, a small network classifies them."""
    pool, _, counts, vectors, marked = _attention(spark, sf)
    pooled = pool.pool(counts, "doc_id", vectors, marked.select("doc_id")).withColumn(M.FEATURES, array_to_vector("vec"))
    ready = pooled.join(marked.select("doc_id", F.col("y").cast("double").alias(M.LABEL), "in_train"), "doc_id")
    train, test = ready.where("in_train"), ready.where("NOT in_train")
    fitted = M.fit_classifier(train, "dnn", pool.shape.classes, "doc_id")
    return fitted.transform(test, "doc_id").select("doc_id", F.col(M.LABEL).alias("true"), F.col(M.PREDICTION).alias("pred"))


@query("early_stop")
def early_stop(spark, sf):
    """History of a softmax regression that stops when the held-back vectors gain nothing."""
    train, check = _halves(_vectors(spark, sf), "vec_id", M.LABEL)
    classes = int(train.agg(F.max(M.LABEL)).first()[0]) + 1
    rows = [stage_table(df.select(F.col(M.LABEL).cast("int").alias("y"), M.vector_to_array(M.FEATURES).alias("x")), "early") for df in (train, check)]
    width = len(rows[0].first()["x"])
    return solver.history_table(spark, solver.fit_softmax(rows[0], classes, width, rows[1], l2=1e-3))


BOOST_ROUNDS = 3


def _boost_sql() -> str:
    """Boosted single words, then every document's vote shares."""
    classes = sorted(CUES)
    k = len(classes)
    p = [f"sum(CASE WHEN y = {c} THEN w ELSE 0.0 END)" for c in range(k)]
    first = lambda x: "CASE " + " ".join(f"WHEN {x}{c} = greatest({', '.join(f'{x}{j}' for j in range(k))}) THEN {c}" for c in range(k)) + " END"
    best = lambda x: f"greatest({', '.join(f'{x}{j}' for j in range(k))})"
    steps = []
    for r in range(BOOST_ROUNDS):
        sums = ", ".join(f"round({e}, {selection.DIGITS}) AS a{c}, round(any_value(t{c}) - {e}, {selection.DIGITS}) AS b{c}" for c, e in enumerate(p))
        steps.append(f"""
t{r} AS (SELECT {', '.join(f'{e} AS t{c}' for c, e in enumerate(p))}, sum(w) AS total FROM w{r}),
s{r} AS (SELECT id, any_value(total) AS total, {sums} FROM post JOIN w{r} USING (doc_id) CROSS JOIN t{r} GROUP BY id),
g{r} AS (SELECT id, total, {first('a')} AS x, {first('b')} AS z, round(total - {best('a')} - {best('b')}, {selection.DIGITS}) / total AS e FROM s{r} ORDER BY round(total - {best('a')} - {best('b')}, {selection.DIGITS}), id LIMIT 1),
v{r} AS (SELECT *, ln((1 - e) / greatest(e, 1e-10)) + ln({k - 1}) AS vote FROM g{r}),
c{r} AS (SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM post JOIN v{r} USING (id)) THEN x ELSE z END AS said, vote FROM labels_ CROSS JOIN v{r}),
w{r + 1} AS (SELECT doc_id, y, w * exp(CASE WHEN said <> y THEN vote ELSE 0 END) / (total * ((1 - e) + e * exp(vote))) AS w
  FROM w{r} JOIN (SELECT doc_id, said FROM c{r}) USING (doc_id) CROSS JOIN v{r})""")
    names = "CASE lang " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(classes)) + " END"
    shares = [" + ".join(f"CASE WHEN c{r}.said = {c} THEN c{r}.vote ELSE 0 END" for r in range(BOOST_ROUNDS)) for c in range(k)]
    total = " + ".join(f"c{r}.vote" for r in range(BOOST_ROUNDS))
    return f"""WITH {notes_sql()},
tf AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(toks) AS word FROM notes) GROUP BY doc_id, word),
ids AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) - 1 AS id FROM (SELECT word, sum(n) AS n FROM tf GROUP BY word)),
post AS (SELECT doc_id, id FROM tf JOIN ids USING (word)),
labels_ AS (SELECT doc_id, {names} AS y FROM documents),
w0 AS (SELECT doc_id, y, 1.0::DOUBLE / count(*) OVER () AS w FROM labels_),
{",".join(steps)}
SELECT doc_id, {", ".join(f"round(({e}) / ({total}), 6) AS p_{x}" for x, e in zip(classes, shares))}
FROM {' JOIN '.join(f'c{r}' if not r else f'c{r} USING (doc_id)' for r in range(BOOST_ROUNDS))}"""


@query("adaboost_text", _boost_sql())
def adaboost_text(spark, sf):
    """Three rounds of boosting over single words: vote shares of every document."""
    bundle = M.fit_bundle(_texts(spark, sf), M.Spec("bow", "adaboost"), "doc_id", "lang", rounds=BOOST_ROUNDS)
    scored = bundle.transform(_texts(spark, sf))
    return scored.select("doc_id", *[F.round(F.col(M.PROBS)[i], 6).alias(f"p_{x}") for i, x in enumerate(bundle.labels)])


SIZE_CLASS = "CASE WHEN n_chars < 1000 THEN 's' WHEN n_chars < 3000 THEN 'm' ELSE 'l' END"


@query(
    "chi2_features",
    f"WITH {notes_sql()}, d AS (SELECT doc_id, {SIZE_CLASS} AS size FROM documents), "
    "rows_ AS (SELECT doc_id, size, unnest(toks) AS word FROM notes JOIN d USING (doc_id)), "
    "obs AS (SELECT word, size, count(*) AS o FROM rows_ GROUP BY word, size), tot AS (SELECT word, sum(o) AS t FROM obs GROUP BY word), "
    "share AS (SELECT size, count(*) * 1.0::DOUBLE / sum(count(*)) OVER () AS p FROM d GROUP BY size), "
    "stat AS (SELECT t.word, exp(-sum((coalesce(o.o, 0) - t.t * s.p) * (coalesce(o.o, 0) - t.t * s.p) / (t.t * s.p)) / 2) AS p "
    "FROM tot t CROSS JOIN share s LEFT JOIN obs o ON o.word = t.word AND o.size = s.size GROUP BY t.word), "
    "bound AS (SELECT max(p) AS b FROM (SELECT p, row_number() OVER (ORDER BY p, word) AS r, count(*) OVER () AS m FROM stat) WHERE p <= r * (0.05 / m)) "
    "SELECT doc_id, word, count(*) AS n FROM rows_ JOIN stat USING (word) WHERE p <= (SELECT b FROM bound) GROUP BY doc_id, word",
)
def chi2_features(spark, sf):
    """Counts of the words that differ between short, middle and long documents; three classes, so the tail is exp(-x / 2)."""
    notes = documents(spark, sf).select("doc_id", F.col("text").alias("bow"), F.expr(SIZE_CLASS).alias("size"))
    fitted = M.fit_features(notes, M.Spec("bow", "nb"), label="size", select="chi2")
    rows = term_rows(M.with_vectors(fitted, M.with_feature(notes, "bow"), "doc_id"), "doc_id")
    return named(rows, fitted.dictionary, ["_key", "id"]).select(F.col("_key").alias("doc_id"), "word", F.col("w").cast("bigint").alias("n"))


@query("calibrated_probs")
def calibrated_probs(spark, sf):
    """Calibrated class shares of held-out vectors; they sum to one."""
    train, test = _halves(_vectors(spark, sf), "vec_id", M.LABEL)
    classes = int(train.agg(F.max(M.LABEL)).first()[0]) + 1
    fitted = M.fit_classifier(train, "svmlin", classes, "vec_id")
    return fitted.transform(test, "vec_id").select("vec_id", F.posexplode(M.PROBS).alias("class", "share"))


@query("cv_scores")
def cv_scores(spark, sf):
    """Two features x two algorithms under stratified folds."""
    notes = documents(spark, sf).select("doc_id", F.col("text").alias("bow"), "source", "lang")
    result = jobs.cross_validate(notes, "doc_id", "lang", "bow+bow_source", "nb+l2", "freq", reps=1, k=5)
    return result.scores


@query("cv_predictions")
def cv_predictions(spark, sf):
    notes = _texts(spark, sf)
    result = jobs.cross_validate(notes, "doc_id", "lang", "bow", "nb", "tfidf", reps=2, k=5)
    return result.predictions.withColumn("probs", F.to_json("probs"))


def _saved_bundle(spark, sf):
    bundle = M.fit_bundle(_texts(spark, sf), M.Spec("bow", "nb", "freq"), "doc_id", "lang")
    return save_bundle(bundle, scratch_path(spark, "model"), spark)


SCORED = (
    f"WITH {notes_sql()}, "
    + _bayes_sql("SELECT lang, toks FROM notes", f"SELECT item_id, {content_tokens()} AS toks FROM benchmark", "item_id")
    + f" {_wide('item_id', '', 'pred_class')}"
)


@query("predictions", SCORED)
def predictions(spark, sf):
    """A saved model, loaded again, scores the benchmark texts."""
    path = _saved_bundle(spark, sf)
    notes = table(spark, sf, "benchmark", "item_id").select("item_id", F.col("text").alias("bow"))
    return _rounded(jobs.score(spark, path, notes, "item_id"))


@query("stream_score", SCORED)
def stream_score(spark, sf):
    """The same, with the benchmark file read as a stream."""
    bundle = M.Bundle.load(_saved_bundle(spark, sf), spark)
    schema = spark.read.parquet(f"{sf}/benchmark.parquet").schema
    notes = note_stream(spark, sf, schema, "benchmark.parquet").select("item_id", F.col("text").alias("bow"))
    out = scratch_path(spark, "scored")
    score_stream(notes, bundle, "item_id", out, scratch_path(spark, "progress")).awaitTermination()
    return _rounded(scored_notes(spark, out))


@query("probe")
def probe(spark, sf):
    """How well linear models read the embedding table: one score row per algorithm."""
    marked = splits.hash_split(_vectors(spark, sf), "vec_id")
    train, test = marked.where("in_train").drop("in_train"), marked.where("NOT in_train").drop("in_train")
    classes = int(train.agg(F.max(M.LABEL)).first()[0]) + 1
    out = None
    for code in ("l1", "svmlin"):
        fitted = M.fit_classifier(train, code, classes, "vec_id")
        preds = fitted.transform(test, "vec_id").select(F.col(M.LABEL).alias("true"), F.col(M.PREDICTION).alias("pred"))
        row = weighted_scores(preds).withColumn("algorithm", F.lit(code))
        out = row if out is None else out.unionByName(row)
    return out


def _count_features(spark, sf, weighting="freq"):
    notes = _texts(spark, sf)
    pipe = M.fit_features(notes, M.Spec("bow", "l2", weighting))
    ready = M.with_vectors(pipe, M.with_feature(notes, "bow"), "doc_id")
    return pipe, M.label_indexer("lang").fit(notes).transform(ready).select("doc_id", M.FEATURES, M.LABEL)


@query("fit_history")
def fit_history(spark, sf):
    pipe, ready = _count_features(spark, sf, "tfidf")
    wide = ready.persist(StorageLevel.MEMORY_AND_DISK)  # read for its size, the scales of the words and the solver's blocks
    try:
        values, classes = wide.agg(F.sum(F.size(F.unwrap_udt(M.FEATURES)["values"])), F.max(M.LABEL) + 1).first()
        few = wide.coalesce(M.solver_parts(wide, values or 0, (M.feature_width(pipe) or 1) * int(classes or 1)))  # a gradient has all classes
        model = LogisticRegression(labelCol=M.LABEL, featuresCol=M.FEATURES, maxIter=100, regParam=0.01).fit(few)
    finally:
        wide.unpersist()
    return M.history_table(spark, model)


@query("top_features")
def top_features(spark, sf):
    """The twenty heaviest terms per language in a linear model."""
    bundle = M.fit_bundle(_texts(spark, sf), M.Spec("bow", "l2", "tfidf"), "doc_id", "lang")
    return M.top_features(spark, bundle)


@query(
    "top_features_nb",
    f"WITH {notes_sql()}, "
    + _bayes_sql("SELECT lang, toks FROM notes WHERE lang IS NOT NULL", "SELECT doc_id, toks FROM notes WHERE FALSE", "doc_id")
    + ", wt AS (SELECT lang, lik.word, ln((lik.n + 1.0::DOUBLE) / (cls.words + (SELECT count(*) FROM voc))) AS weight, lik.n, "
    "sum(lik.n) OVER (PARTITION BY lik.word) AS all_n FROM lik JOIN cls USING (lang)) "
    "SELECT lang AS class, row_number() OVER (PARTITION BY lang ORDER BY n DESC, all_n DESC, word) AS place, word, round(weight, 6) AS weight "
    "FROM wt QUALIFY place <= 20",
)
def top_features_nb(spark, sf):
    """The twenty likeliest words of each language in naive Bayes."""
    bundle = M.fit_bundle(_texts(spark, sf).where("lang IS NOT NULL"), M.Spec("bow", "nb"), "doc_id", "lang")
    return M.top_features(spark, bundle).withColumn("weight", F.round("weight", 6))


@query("tuned")
def tuned(spark, sf):
    """Regularisation chosen on a validation share."""
    ready = _vectors(spark, sf)
    estimator = LogisticRegression(labelCol=M.LABEL, featuresCol=M.FEATURES, maxIter=50)
    grid = ParamGridBuilder().addGrid(estimator.regParam, [0.001, 0.01, 0.1]).build()
    judge = MulticlassClassificationEvaluator(labelCol=M.LABEL, metricName="logLoss")
    fitted = TrainValidationSplit(estimator=estimator, estimatorParamMaps=grid, evaluator=judge, trainRatio=0.7,
                                  parallelism=3, seed=42).fit(ready)
    losses = fitted.validationMetrics
    rows = [(float(p[estimator.regParam]), float(v), v == min(losses)) for p, v in zip(grid, losses)]
    return spark.createDataFrame(rows, "reg double, loss double, chosen boolean")


@query("lasso_terms")
def lasso_terms(spark, sf):
    """Terms with a non-zero weight in an L1 regression on the class number."""
    pipe, ready = _count_features(spark, sf, "tfidf")
    wide = ready.persist(StorageLevel.MEMORY_AND_DISK)  # read for its size, the scales of the words and the solver's blocks
    try:
        values = wide.agg(F.sum(F.size(F.unwrap_udt(M.FEATURES)["values"]))).first()[0]
        few = wide.coalesce(M.solver_parts(wide, values or 0, M.feature_width(pipe) or 1))
        model = LinearRegression(labelCol=M.LABEL, featuresCol=M.FEATURES, elasticNetParam=1.0, regParam=0.01, maxIter=100,
                                 solver="l-bfgs").fit(few)
    finally:
        wide.unpersist()
    weights = model.coefficients.toArray()
    rows = spark.createDataFrame([(int(i), float(weights[i])) for i in weights.nonzero()[0]], "id int, weight double")
    return named(rows, pipe.dictionary, ["id"]).select("word", "weight")


@query("topics")
def topics(spark, sf):
    """Ten topics, the ten heaviest terms of each."""
    pipe, ready = _count_features(spark, sf)
    model = LDA(featuresCol=M.FEATURES, k=10, maxIter=20, seed=42, optimizer="online").fit(ready)
    heavy = model.describeTopics(10).select(F.col("topic").cast("bigint").alias("topic"), F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("i", "x"))
    rows = heavy.select("topic", (F.col("i") + 1).cast("bigint").alias("place"), F.col("x.termIndices").alias("id"), F.col("x.termWeights").alias("weight"))
    return named(rows, pipe.dictionary, ["topic", "id"]).select("topic", "place", "word", "weight")

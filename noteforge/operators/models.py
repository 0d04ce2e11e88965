"""Featurisers, classifiers and their common prediction shape.

Every classifier turns a ``features`` column into ``probs`` (one share per
class, in class order) and ``prediction`` (the class number). Fitting is
``pyspark.ml``; scoring is a projection, with no shuffle.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    DecisionTreeClassificationModel,
    DecisionTreeClassifier,
    LinearSVC,
    LinearSVCModel,
    LogisticRegression,
    LogisticRegressionModel,
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    NaiveBayesModel,
    OneVsRest,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import (
    HashingTF,
    SQLTransformer,
    StopWordsRemover,
    StringIndexer,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noteforge import fixed
from noteforge.functions.arrays import argmax, normalise
from noteforge.functions.stem import stem_word
from noteforge.functions.text import WORD_GAP
from noteforge.operators.dictionary import FEATURES, TERMS, TableFeatures, TableFeaturiser, named, term_rows
from noteforge.operators.joins import lookup_join
from noteforge.operators.margins import Machine, blocks_of, fit_machines, plane_margins, unseen_margins
from noteforge.operators.paragraphs import ParagraphFeatures, ParagraphFeaturiser, Settings
from noteforge.operators.planes import Goal, fit_planes
from noteforge.operators.selection import Stump, boost_terms, chi2_dictionary, votes
from noteforge.operators.skipgram import SkipGram, WordFeatures, WordFeaturiser
from noteforge.operators.splits import stratified_folds
from noteforge.runtime import Workspace, stage, stage_table

LABEL, PROBS, PREDICTION = "label_idx", "probs", "prediction"
DENSE_WIDTH = 4096  # up to here a projection is a plain matrix
SLOTS = 1024  # of hashed places beyond
PARALLEL_FITS = 8  # fits that run side by side
FIT_PART_BYTES = 8 * 1024 * 1024  # vector bytes worth a task of their own
FIT_TASKS = 4  # for each core, of a solver step; each sends a gradient
SOLVER_VECTORS = 24  # ten curvature pairs, and where the solver stands
DRIVER_BYTES = 256 * 1024 * 1024  # of such vectors; beyond, they stay on the executors
FOURIER = 256  # kernel features
KERNELS = {"svmrbf"}  # fitted on kernel features, whatever the width of the vectors
KERNEL_PART_BYTES = 256 * 1024 * 1024  # of kernel features, in a task at most

# --------------------------------------------------------------------------
# text -> features
# --------------------------------------------------------------------------

PROSE_TOKENS = (
    f"filter(split(lower(coalesce({{text}}, '')), r'{WORD_GAP}'), "
    "t -> length(t) > 2 AND NOT t RLIKE '^[0-9.]')"
)
CODE_TOKENS = r"filter(split(lower(coalesce({text}, '')), r'\s+'), t -> t <> '')"


def token_stages(text: str, tokens_sql: str = PROSE_TOKENS, stop_words=tuple(fixed.STOP_WORDS)) -> list:
    """Stages that add ``tokens``; ``tokens_sql`` is an expression over ``{text}``."""
    made = "raw_tokens" if stop_words else "tokens"
    split = SQLTransformer(statement=f"SELECT *, {tokens_sql.replace('{text}', text)} AS {made} FROM __THIS__")
    if not stop_words:
        return [split]
    return [split, StopWordsRemover(inputCol=made, outputCol="tokens", stopWords=list(stop_words))]


class StemTokens(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Every token of an array becomes its stem."""

    def __init__(self, inputCol: str | None = None, outputCol: str | None = None):
        super().__init__()
        if inputCol:
            self._set(inputCol=inputCol)
        if outputCol:
            self._set(outputCol=outputCol)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getOutputCol(), F.transform(self.getInputCol(), stem_word))


def pv_words(dim: int = 600, window: int = 10, min_count: int = 1, parts: int | None = None,
             iterations: int = 1, seed: int = 42, **_) -> SkipGram:
    return word2vec(dim, window, min_count, parts, iterations, seed, output=FEATURES)


def word2vec(dim: int = 300, window: int = 5, min_count: int = 1, parts: int | None = None, iterations: int = 1,
             seed: int = 42, output: str = "vec") -> SkipGram:
    """Skip-gram vectors, fitted in ``parts`` tasks: by default, one for each core of the session, more for many tokens."""
    return SkipGram(dim, window, min_count, parts, max(iterations, 1), seed, output)


def hashing_stages(width: int = 1 << 18, **_) -> list:
    return [HashingTF(inputCol="tokens", outputCol=FEATURES, numFeatures=width)]


#: Fitted as word tables, as trained paragraph vectors, as the mean of word vectors, or as stages that need no dictionary.
TABLE_WEIGHTINGS = ("freq", "tfidf")
PARAGRAPHS = "d2v"
WORDS = "pv"
STAGES: dict[str, Callable[..., list]] = {"hash": hashing_stages}
FEATURISERS = (*TABLE_WEIGHTINGS, PARAGRAPHS, WORDS, *STAGES)


def featuriser(vec: str, text: str, codes: bool = False, tokens_sql: str | None = None, stem: bool = False,
               vocab_size: int | None = None, key: str | None = None, label: str | None = None, select: str | None = None,
               alpha: float = 0.05, **options) -> TableFeaturiser | ParagraphFeaturiser | WordFeaturiser | Pipeline:
    """Tokens and their vectors. ``stem`` stems prose after stop words are gone; codes are never stemmed.

    ``select="chi2"`` keeps the words that differ between the values of ``label``; paragraph
    vectors need the ``key`` that names a note.
    """
    if vec not in FEATURISERS:
        raise ValueError(f"unknown vectoriser {vec!r}; one of {sorted(FEATURISERS)}")
    tokens_sql = tokens_sql or (CODE_TOKENS if codes else PROSE_TOKENS)
    stop_words = () if codes else tuple(fixed.STOP_WORDS)
    stems = [StemTokens("tokens", "tokens")] if stem and not codes else []
    stages = [*token_stages(text, tokens_sql, stop_words), *stems]
    if select not in (None, "chi2") or select and (vec not in TABLE_WEIGHTINGS or label is None):
        raise ValueError(f"can't select by {select!r} here: 'chi2' needs a dictionary and a label")
    if vec in TABLE_WEIGHTINGS:
        choose = (lambda notes, dictionary: chi2_dictionary(notes, label, dictionary, alpha)) if select else None
        return TableFeaturiser(stages, vec, vocab_size, choose)
    if vec == PARAGRAPHS:
        if key is None:
            raise ValueError("paragraph vectors need a key")
        return ParagraphFeaturiser(stages, Settings(**options), key, vocab_size)
    if vec == WORDS:
        return WordFeaturiser(stages, pv_words(**options))
    return Pipeline(stages=[*stages, *STAGES[vec](**options)])


KEYED = {"terms": TableFeatures, "paragraphs": ParagraphFeatures, "words": WordFeatures}
Features = TableFeatures | ParagraphFeatures | WordFeatures | PipelineModel


def with_vectors(features: Features, notes: DataFrame, key: str) -> DataFrame:
    """Add ``features`` (and ``terms``, of a dictionary) to notes named by ``key``."""
    return features.transform(notes) if isinstance(features, PipelineModel) else features.transform(notes, key)


def vector_columns(df: DataFrame, codes: list[str]) -> list[str]:
    """The columns that the given algorithms read."""
    terms = TERMS in df.columns
    return [*([FEATURES] if not terms or set(codes) - READS_TERMS else []), *([TERMS] if terms and set(codes) & READS_TERMS else [])]


def label_indexer(label: str) -> StringIndexer:
    return StringIndexer(inputCol=label, outputCol=LABEL, stringOrderType="alphabetAsc", handleInvalid="error")


# --------------------------------------------------------------------------
# fitted classifiers
# --------------------------------------------------------------------------

MODEL_CLASSES = {
    c.__name__: c
    for c in (
        LogisticRegressionModel, LinearSVCModel, NaiveBayesModel, RandomForestClassificationModel,
        MultilayerPerceptronClassificationModel, DecisionTreeClassificationModel,
    )
}


def _sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def fourier_map(seed: int, inputs: int, outputs: int, gamma: float) -> Callable[[Column], Column]:
    """Random Fourier features of the RBF kernel of dense vectors; the projection follows from the seed."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, math.sqrt(2.0 * gamma), size=(inputs, outputs))
    b = rng.uniform(0.0, 2.0 * math.pi, size=outputs)

    @F.pandas_udf("array<double>")
    def project(rows: pd.Series) -> pd.Series:
        x = np.vstack(rows.to_numpy()) if len(rows) else np.zeros((0, inputs))
        z = np.cos(x @ w + b) * math.sqrt(2.0 / outputs)
        return pd.Series(list(z))

    return lambda features: project(vector_to_array(features))


def mixed(ids: np.ndarray, seed: int) -> np.ndarray:
    """64 well mixed bits of each number."""
    with np.errstate(over="ignore"):
        h = (ids.astype(np.uint64) + np.uint64(seed + 1)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of every row; the width is a power of two."""
    n, width = x.shape
    half = 1
    while half < width:
        x = x.reshape(n, -1, 2, half)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        half *= 2
    return x.reshape(n, width)


def sparse_fourier(rows: list[tuple[np.ndarray, np.ndarray]], seed: int, outputs: int, gamma: float, slots: int) -> np.ndarray:
    """Fourier features of the RBF kernel of sparse rows (places, values), without a matrix of their width.

    Places are hashed, with signs, into ``slots``. A block of ``slots`` projections is signs,
    Hadamard transform, permutation, Gaussian scales, Hadamard transform and chi-distributed
    lengths; as many blocks are made as ``outputs`` need. All of it follows from the seed.
    """
    x = np.zeros((len(rows), slots))
    for i, (places, values) in enumerate(rows):
        h = mixed(places, seed)
        sign = np.where(h >> np.uint64(63), 1.0, -1.0)
        x[i] = np.bincount((h % np.uint64(slots)).astype(np.int64), sign * values, slots)
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(-(-outputs // slots)):
        sign, order, scale = rng.choice([-1.0, 1.0], slots), rng.permutation(slots), rng.normal(size=slots)
        lengths = np.sqrt(rng.chisquare(slots, slots)) / np.linalg.norm(scale)
        y = hadamard(hadamard(x * sign)[:, order] * scale) * lengths / math.sqrt(slots)
        out.append(np.cos(math.sqrt(2.0 * gamma) * y + rng.uniform(0.0, 2.0 * math.pi, slots)))
    return np.concatenate(out, axis=1)[:, :outputs] * math.sqrt(2.0 / outputs)


def sparse_fourier_map(seed: int, outputs: int, gamma: float, slots: int) -> Callable[[Column], Column]:
    @F.pandas_udf("array<double>")
    def project(ids: pd.Series, values: pd.Series) -> pd.Series:
        parts = []
        for at in range(0, len(ids), 256):
            rows = [(np.asarray(i, np.int64), np.asarray(v, np.float64)) for i, v in zip(ids[at : at + 256], values[at : at + 256])]
            parts += list(sparse_fourier(rows, seed, outputs, gamma, slots))
        return pd.Series(parts, dtype=object)

    def of(features: Column) -> Column:
        inner = F.unwrap_udt(features)
        ids = F.coalesce(inner["indices"], F.sequence(F.lit(0), F.size(inner["values"]) - 1))  # of dense vectors
        return project(ids, inner["values"])

    return of


def kernel_map(settings: dict) -> Callable[[Column], Column]:
    """From vectors to arrays of kernel features."""
    return sparse_fourier_map(**settings) if "slots" in settings else fourier_map(**settings)


def both_sides(margins: list[Column]) -> list[Column]:
    """One margin a class: of two classes, only the second one's is fitted."""
    return [-margins[0], margins[0]] if len(margins) == 1 else margins


@dataclass(frozen=True)
class Plane:
    """A linear model whose weights are a column of a table."""

    intercept: float


@dataclass
class Classifier:
    """A fitted classifier of one of six kinds.

    ``native``: one multiclass model; ``one_vs_rest``: a logistic model per
    class; ``calibrated``: a margin model per class with a sigmoid each, on kernel
    features given by its ``planes``, weights and intercepts;
    ``boosted``: weighted votes of small trees; ``stumps``: weighted votes of
    single terms; ``bayes``: naive Bayes as a table of word weights, which is
    joined and never leaves the executors. So are linear models on terms: their ``models`` are
    planes, of which ``lifts`` has the weights.
    """

    kind: str
    models: list
    classes: int
    sigmoids: list[tuple[float, float]] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    fourier: dict | None = None
    lifts: DataFrame | None = None  # (id, lifts): of the classes a word occurs in; (id, weights): of planes
    priors: list[float] = field(default_factory=list)
    floors: list[float] = field(default_factory=list)
    stumps: list[Stump] = field(default_factory=list)
    planes: list[list[float]] = field(default_factory=list)

    def transform(self, df: DataFrame, key: str) -> DataFrame:
        """Add ``probs`` and ``prediction``; ``key`` names a row of ``df``."""
        if self.kind == "bayes":
            return self._bayes(df, key)
        if self.lifts is not None:
            return self._linear(df, key)
        keep = df.columns
        plain = self.fourier and not self.planes
        if plain:
            df = df.withColumn("_plain", F.col(FEATURES)).withColumn(
                FEATURES, array_to_vector(kernel_map(self.fourier)(F.col(FEATURES)))
            )
        df, probs = self._probs(df)
        df = df.withColumn(PROBS, probs).withColumn(PREDICTION, argmax(PROBS).cast("double"))
        if plain:
            df = df.withColumn(FEATURES, F.col("_plain"))
        return df.select(*keep, PROBS, PREDICTION)

    def _bayes(self, df: DataFrame, key: str) -> DataFrame:
        """Class sums of a note's terms by one join and one aggregate; what a class lacks adds its floor."""
        terms = lookup_join(term_rows(df, key), self.lifts, "id", spread_by=["_key", "id"], staged=True)
        known = F.sum("w").alias("_mass")
        hits = terms.withColumn("x", F.map_from_entries("lifts"))
        sums = [F.coalesce(F.sum(F.col("w") * F.col("x")[c]), F.lit(0.0)).alias(f"_s{c}") for c in range(self.classes)]
        found = hits.groupBy("_key").agg(known, *sums)
        joined = df.join(found, F.col(key).eqNullSafe(F.col("_key")), "left")
        mass = F.coalesce("_mass", F.lit(0.0))
        score = [F.lit(p) + mass * F.lit(f) + F.coalesce(f"_s{c}", F.lit(0.0)) for c, (p, f) in enumerate(zip(self.priors, self.floors))]
        joined = joined.withColumn("_score", F.array(*score)).withColumn("_top", F.array_max("_score"))
        shares = normalise(F.transform("_score", lambda s: F.exp(s - F.col("_top"))))
        return joined.withColumn(PROBS, shares).withColumn(PREDICTION, argmax("_score").cast("double")).select(*df.columns, PROBS, PREDICTION)

    def _linear(self, df: DataFrame, key: str) -> DataFrame:
        """Margins of a note's terms by one join and one aggregate; notes that share a key have the same terms."""
        notes = df.select(key, TERMS).dropDuplicates([key])
        terms = lookup_join(term_rows(notes, key), self.lifts, "id", spread_by=["_key", "id"], staged=True)
        found = terms.groupBy("_key").agg(*[F.sum(F.col("w") * F.col("weights")[i]).alias(f"_m{i}") for i in range(len(self.models))])
        joined = df.join(found, F.col(key).eqNullSafe(F.col("_key")), "left")
        margins = both_sides([F.coalesce(f"_m{i}", F.lit(0.0)) + F.lit(p.intercept) for i, p in enumerate(self.models)])
        joined = joined.withColumn(PROBS, normalise(F.array(*[_sigmoid(m) for m in margins]))).withColumn(PREDICTION, argmax(PROBS).cast("double"))
        return joined.select(*df.columns, PROBS, PREDICTION)

    def margins(self, df: DataFrame) -> tuple[DataFrame, list[Column]]:
        out = []
        if self.planes:
            df = df.withColumn("_m", plane_margins(np.array(self.planes))(kernel_map(self.fourier)(F.col(FEATURES))))
            return df, both_sides([F.col("_m")[i] for i in range(len(self.planes))])
        for i, model in enumerate(self.models):
            model = model.copy().setRawPredictionCol(f"_raw{i}").setPredictionCol("")
            if model.hasParam("probabilityCol"):
                model = model.setProbabilityCol("")
            df = model.transform(df)
            out.append(vector_to_array(F.col(f"_raw{i}"))[1])
        return df, both_sides(out)

    def _probs(self, df: DataFrame) -> tuple[DataFrame, Column]:
        if self.kind == "native":
            model = self.models[0].copy().setRawPredictionCol("").setPredictionCol("").setProbabilityCol("_p")
            return model.transform(df), vector_to_array(F.col("_p"))
        if self.kind == "one_vs_rest":
            df, margins = self.margins(df)
            return df, normalise(F.array(*[_sigmoid(m) for m in margins]))
        if self.kind == "calibrated":
            df, margins = self.margins(df)
            shares = [_sigmoid(m * a + b) for m, (a, b) in zip(margins, self.sigmoids)]
            return df, normalise(F.array(*shares))
        if self.kind == "stumps":
            return df, votes(self.stumps, self.classes)
        if self.kind == "boosted":
            tallies = [F.lit(0.0)] * self.classes
            for i, (tree, alpha) in enumerate(zip(self.models, self.weights)):
                tree = tree.copy().setPredictionCol(f"_t{i}").setRawPredictionCol("").setProbabilityCol("")
                df = tree.transform(df)
            for c in range(self.classes):
                for i, alpha in enumerate(self.weights):
                    tallies[c] = tallies[c] + F.when(F.col(f"_t{i}") == c, alpha).otherwise(0.0)
            return df, normalise(F.array(*tallies))
        raise ValueError(self.kind)

    def save(self, path: str, spark: SparkSession) -> None:
        planes = [m.intercept for m in self.models if isinstance(m, Plane)]
        models = [] if planes else self.models
        for i, model in enumerate(models):
            model.write().overwrite().save(f"{path}/model_{i:03d}")
        meta = {
            "kind": self.kind, "classes": self.classes, "sigmoids": self.sigmoids, "weights": self.weights,
            "fourier": self.fourier, "models": [type(m).__name__ for m in models], "intercepts": planes,
            "priors": self.priors, "floors": self.floors, "stumps": [asdict(x) for x in self.stumps],
            "planes": self.planes,
        }
        if self.lifts is not None:
            self.lifts.write.mode("overwrite").parquet(f"{path}/lifts")
        write_json(spark, f"{path}/classifier", meta)

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> Classifier:
        meta = read_json(spark, f"{path}/classifier")
        models = [MODEL_CLASSES[name].load(f"{path}/model_{i:03d}") for i, name in enumerate(meta["models"])]
        planes = [Plane(x) for x in meta.get("intercepts", [])]
        lifts = spark.read.parquet(f"{path}/lifts") if meta["kind"] == "bayes" or planes else None
        return cls(meta["kind"], planes or models, meta["classes"], [tuple(s) for s in meta["sigmoids"]],
                   meta["weights"], meta["fourier"], lifts, meta["priors"], meta["floors"],
                   [Stump(**x) for x in meta["stumps"]], meta.get("planes", []))


def write_json(spark: SparkSession, path: str, value) -> None:
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str):
    return json.loads(spark.read.text(path).first()[0])


# --------------------------------------------------------------------------
# fitting
# --------------------------------------------------------------------------


def _balanced(label: Column, counts: dict[int, int]) -> Column:
    """``n / (classes * count)`` per row, from the class counts."""
    total, k = sum(counts.values()), len(counts)
    out = F.lit(1.0)
    for c, n in counts.items():
        out = F.when(label == c, F.lit(total / (k * n))).otherwise(out)
    return out


def class_counts(df: DataFrame) -> dict[int, int]:
    return {int(r[0]): int(r[1]) for r in df.groupBy(LABEL).count().collect()}


def _sides(counts: dict[int, int], c: int) -> tuple[float, float]:
    """Weights of class ``c`` and of the others, at which both sides weigh the same."""
    total, own = sum(counts.values()), counts.get(c, 0)
    return total / (2.0 * max(own, 1)), total / (2.0 * max(total - own, 1))


def fit_binary(df: DataFrame, estimator: Estimator, c: int, counts: dict[int, int] | None = None):
    """Class ``c`` against the others; with ``counts`` both sides weigh the same."""
    binary = df.select(FEATURES, (F.col(LABEL) == c).cast("double").alias("_y"))
    settings = {estimator.labelCol: "_y"}
    if counts:
        own, other = _sides(counts, c)
        share = F.when(F.col("_y") == 1.0, own).otherwise(other)
        binary = binary.withColumn("_w", share)
        settings[estimator.weightCol] = "_w"
    return estimator.copy(settings).fit(binary)


def side_by_side(spark: SparkSession, fn: Callable, *args: list) -> list:
    """Run independent fits from a few driver threads."""
    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        return list(pool.map(inheritable_thread_target(spark)(fn), *args))


def one_vs_rest(df: DataFrame, estimator: Estimator, classes: int, balanced: bool = False) -> list:
    """One binary model per class, or a single one when there are two classes."""
    counts = class_counts(df) if balanced else None
    if classes == 2:
        return [fit_binary(df, estimator, 1, counts)]
    if not balanced:
        wrapped = OneVsRest(classifier=estimator, labelCol=LABEL, featuresCol=FEATURES, parallelism=PARALLEL_FITS)
        return wrapped.fit(df.select(FEATURES, LABEL)).models
    return side_by_side(df.sparkSession, lambda c: fit_binary(df, estimator, c, counts), list(range(classes)))


LOGISTIC_TOLERANCE = 1e-4


def _logistic(n: int, l1: float, max_iter: int) -> LogisticRegression:
    return LogisticRegression(
        labelCol=LABEL, featuresCol=FEATURES, regParam=1.0 / max(n, 1), elasticNetParam=l1,
        standardization=False, maxIter=max_iter, tol=LOGISTIC_TOLERANCE,
    )


MARGIN_TOLERANCE = 1e-3  # the hinge has kinks: below it the solver only searches lines


def _margin(reg: float, max_iter: int) -> LinearSVC:
    return LinearSVC(
        labelCol=LABEL, featuresCol=FEATURES, regParam=reg, maxIter=max_iter, standardization=False, tol=MARGIN_TOLERANCE
    )


def calibrate(df: DataFrame, estimator: Estimator, classes: int, key: str, folds: int = 5,
              balanced: bool = False) -> Classifier:
    """Margin models with sigmoids fitted on out-of-fold margins.

    Each fold is scored by models that did not see it; the sigmoid of a class
    is a one-dimensional logistic fit over all those margins. The margin
    models that score new rows are fitted on everything.
    """
    spark = df.sparkSession
    parts = df.rdd.getNumPartitions()
    folded = stratified_folds(df.select(key, FEATURES, LABEL), key, LABEL, folds).coalesce(parts)
    folded = folded.persist(StorageLevel.MEMORY_AND_DISK)
    counts = class_counts(folded) if balanced else None
    targets = [1] if classes == 2 else list(range(classes))
    jobs = [(f, c) for f in [*range(folds), None] for c in targets]

    def fit(job):
        f, c = job
        rows = folded if f is None else folded.where(F.col("fold") != f)
        return fit_binary(rows, estimator, c, counts)

    models = dict(zip(jobs, side_by_side(spark, fit, jobs)))
    held_out = []
    for f in range(folds):
        unseen = Classifier("calibrated", [models[f, c] for c in targets], classes)
        part, margins = unseen.margins(folded.where(F.col("fold") == f))
        held_out.append(part.select(LABEL, F.array(*margins).alias("m")))
    scored = held_out[0]
    for part in held_out[1:]:
        scored = scored.unionByName(part)
    sigmoids = fit_sigmoids(stage(scored.coalesce(parts)), classes)
    folded.unpersist()
    return Classifier("calibrated", [models[None, c] for c in targets], classes, sigmoids=sigmoids)


def fit_sigmoids(scored: DataFrame, classes: int) -> list[tuple[float, float]]:
    """Slope and intercept of every class, from labels and out-of-fold margins ``m``."""

    def fit_sigmoid(c: int) -> tuple[float, float]:
        flat = scored.select(
            array_to_vector(F.array(F.col("m")[c])).alias("x"), (F.col(LABEL) == c).cast("double").alias("y")
        )
        model = LogisticRegression(featuresCol="x", labelCol="y", maxIter=50).fit(flat)
        return float(model.coefficients[0]), float(model.intercept)

    return side_by_side(scored.sparkSession, fit_sigmoid, list(range(classes)))


def calibrate_kernel(df: DataFrame, fourier: dict, classes: int, key: str, n: int, max_iter: int, folds: int = 5,
                     balanced: bool = False) -> Classifier:
    """As :func:`calibrate`, on kernel features of ``n`` rows; the machines of all folds and classes share their passes over them."""
    width, parts = fourier["outputs"], df.rdd.getNumPartitions()
    folded = stratified_folds(df.select(key, FEATURES, LABEL), key, LABEL, folds).coalesce(parts)
    rows = folded.select(LABEL, F.col("fold").cast("int").alias("fold"), kernel_map(fourier)(F.col(FEATURES)).alias("x"))
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    blocks = blocks_of(rows, width).persist(StorageLevel.MEMORY_AND_DISK)
    counts = class_counts(rows) if balanced else None
    targets = [1] if classes == 2 else list(range(classes))
    machines = [Machine(c, f, *(_sides(counts, c) if counts else ())) for f in [*range(folds), None] for c in targets]
    planes = np.stack(fit_machines(rows, blocks, machines, width, 1.0 / max(n, 1), max_iter, MARGIN_TOLERANCE)).reshape(folds + 1, len(targets), width + 1)
    margins = F.array(*both_sides([F.col("m")[i] for i in range(len(targets))]))
    unseen = df.sparkSession.createDataFrame(unseen_margins(blocks, planes), f"{LABEL} double, m array<double>", verifySchema=False)
    scored = stage(unseen.select(LABEL, margins.alias("m")))
    scored = scored.coalesce(min(parts, math.ceil(n * classes * 12 / FIT_PART_BYTES)))  # far narrower than what they are made of
    blocks.unpersist()
    rows.unpersist()
    return Classifier("calibrated", [], classes, sigmoids=fit_sigmoids(scored, classes), fourier=fourier, planes=planes[folds].tolist())


def fit_terms(df: DataFrame, classes: int, width: int, balanced: bool, max_iter: int = 100) -> Classifier:
    """:func:`_logistic` with a quadratic penalty on terms, one against the rest; nothing of the dictionary's width is on the driver."""
    work = Workspace(df.sparkSession, "terms")
    rows = work.put(df.select(LABEL, TERMS), "rows")
    try:
        n = rows.count()
        if not n:
            raise ValueError("nothing to fit on")
        counts = class_counts(rows) if balanced else None
        targets = [1] if classes == 2 else list(range(classes))
        machines = [Machine(c, None, *(_sides(counts, c) if counts else ())) for c in targets]
        found = fit_planes(rows, machines, width, Goal(max_iter, LOGISTIC_TOLERANCE, 1.0 / n), lambda table: stage_table(table, "planes"))
    finally:
        work.remove("rows")
    return Classifier("one_vs_rest", [Plane(float(b)) for b in found.intercepts], classes, lifts=found.weights)


def boost(df: DataFrame, classes: int, rounds: int = 100, depth: int = 1, cut_every: int = 10) -> Classifier:
    """SAMME boosting of small trees; weights are a column, errors one aggregate per round."""
    n = df.count()
    now = df.select(FEATURES, LABEL, F.lit(1.0 / max(n, 1)).alias("_w")).persist(StorageLevel.MEMORY_AND_DISK)
    held = now
    trees, alphas = [], []
    for r in range(rounds):
        tree = DecisionTreeClassifier(
            featuresCol=FEATURES, labelCol=LABEL, weightCol="_w", maxDepth=depth, seed=r,
            predictionCol="_t", rawPredictionCol="_r", probabilityCol="_q",
        ).fit(now)
        scored = tree.transform(now)
        miss = (F.col("_t") != F.col(LABEL)).cast("double")
        wrong, total = scored.agg(F.sum(F.col("_w") * miss), F.sum("_w")).first()
        err = wrong / total
        if err >= 1.0 - 1.0 / classes:
            break
        alpha = math.log((1.0 - err) / max(err, 1e-10)) + math.log(max(classes - 1, 1))
        trees.append(tree)
        alphas.append(alpha)
        if err <= 0.0:
            break
        rescale = total * ((1.0 - err) + err * math.exp(alpha))
        now = scored.select(FEATURES, LABEL, (F.col("_w") * F.exp(miss * alpha) / rescale).alias("_w"))
        if (r + 1) % cut_every == 0 and r + 1 < rounds:
            now = stage(now).persist(StorageLevel.MEMORY_AND_DISK)
            held.unpersist()
            held = now
    held.unpersist()
    if not trees:
        raise ValueError("no tree is better than chance")
    return Classifier("boosted", trees, classes, weights=alphas)


@dataclass
class FitContext:
    """What a trainer may use: rows, class count, width, the note key, options."""

    classes: int
    rows: int
    width: int
    key: str
    balanced: bool = False
    options: dict = field(default_factory=dict)

    def get(self, name: str, default):
        return self.options.get(name, default)


def _fit_linear(l1: float):
    def fit(df: DataFrame, c: FitContext) -> Classifier:
        estimator = _logistic(c.rows, l1, c.get("max_iter", 100))
        return Classifier("one_vs_rest", one_vs_rest(df, estimator, c.classes, c.balanced), c.classes)

    return fit


def fit_term_bayes(df: DataFrame, classes: int, width: int, smoothing: float = 1.0) -> Classifier:
    """Multinomial naive Bayes on terms: word weights as a table, two numbers a class on the driver.

    A word's likelihood in a class is its lift over a word the class never saw; so a word has
    entries for the classes it occurs in only. Priors are smoothed as the counts are.
    """
    mass = F.aggregate(TERMS, F.lit(0.0), lambda s, t: s + t["w"])
    totals = {int(r[0]): (r["n"], r["mass"]) for r in df.groupBy(LABEL).agg(F.count(F.lit(1)).alias("n"), F.sum(mass).alias("mass")).collect()}
    if not totals:
        raise ValueError("nothing to fit on")
    notes = sum(n for n, _ in totals.values())
    n, words = zip(*[totals.get(c, (0, 0.0)) for c in range(classes)])
    counts = df.select(F.col(LABEL).cast("int").alias("class"), F.inline(TERMS)).groupBy("id", "class").agg(F.sum("w").alias("n"))
    lift = F.log((F.col("n") + F.lit(smoothing)) / F.lit(smoothing))
    lifts = counts.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("class", lift.alias("lift")))).alias("lifts"))
    return Classifier(
        "bayes", [], classes, lifts=stage_table(lifts, "lifts"),
        priors=[math.log((x + smoothing) / (notes + smoothing * classes)) for x in n],
        floors=[math.log(smoothing / (x + smoothing * width)) for x in words],
    )


def _fit_bayes(df: DataFrame, c: FitContext) -> Classifier:
    model = NaiveBayes(labelCol=LABEL, featuresCol=FEATURES, modelType="multinomial", smoothing=1.0).fit(df)
    return Classifier("native", [model], c.classes)


def _fit_svm(df: DataFrame, c: FitContext) -> Classifier:
    estimator = _margin(1.0 / max(c.rows, 1), c.get("max_iter", 100))
    return calibrate(df, estimator, c.classes, c.key, c.get("folds", 5), c.balanced)


def _fit_svm_short(df: DataFrame, c: FitContext) -> Classifier:
    return calibrate(df, _margin(1e-4, 5), c.classes, c.key, c.get("folds", 5), c.balanced)


def _fit_svm_rbf(df: DataFrame, c: FitContext) -> Classifier:
    fourier = {"seed": 0, "outputs": c.get("fourier", FOURIER), "gamma": c.get("gamma", 1.0 / c.width)}
    fourier |= {"slots": c.get("slots", SLOTS)} if c.width > DENSE_WIDTH else {"inputs": c.width}
    return calibrate_kernel(df, fourier, c.classes, c.key, c.rows, c.get("max_iter", 100), c.get("folds", 5), c.balanced)


def _fit_forest(df: DataFrame, c: FitContext) -> Classifier:
    # deep trees: a row keeps its node in each tree, so that no pass sends the forest or walks rows down from the roots
    forest = RandomForestClassifier(
        labelCol=LABEL, featuresCol=FEATURES, numTrees=c.get("trees", 100), maxDepth=c.get("depth", 30), seed=0, cacheNodeIds=True
    )
    if c.balanced:
        df = df.withColumn("_w", _balanced(F.col(LABEL), class_counts(df)))
        forest = forest.setWeightCol("_w")
    return Classifier("native", [forest.fit(df)], c.classes)


def _fit_boost(df: DataFrame, c: FitContext) -> Classifier:
    return boost(df, c.classes, c.get("rounds", 100))


def _fit_perceptron(df: DataFrame, c: FitContext) -> Classifier:
    model = MultilayerPerceptronClassifier(
        labelCol=LABEL, featuresCol=FEATURES, layers=[c.width, 128, 64, 32, c.classes], seed=42,
        maxIter=c.get("max_iter", 200),
    ).fit(df)
    return Classifier("native", [model], c.classes)


ALGORITHMS: dict[str, Callable[[DataFrame, FitContext], Classifier]] = {
    "l1": _fit_linear(1.0),
    "l2": _fit_linear(0.0),
    "nb": _fit_bayes,
    "svmlin": _fit_svm,
    "svmsgd": _fit_svm_short,
    "svmrbf": _fit_svm_rbf,
    "rf": _fit_forest,
    "adaboost": _fit_boost,
    "mlp": _fit_perceptron,
    "dnn": _fit_perceptron,
}
NEEDS_COUNTS = {"nb"}
READS_TERMS = {"nb", "adaboost"}  # of features with a dictionary


def algorithm(code: str) -> Callable[[DataFrame, FitContext], Classifier]:
    if code not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {code!r}; one of {sorted(ALGORITHMS)}")
    return ALGORITHMS[code]


def solver_parts(wide: DataFrame, values: int, width: int) -> int:
    """Parts of the vectors of a solver: a step costs one task and one gradient for each, so small inputs and wide vectors get few,
    and large ones a fixed number."""
    worth = max(FIT_PART_BYTES, FIT_TASKS * 8 * width)
    most = FIT_TASKS * wide.sparkSession.sparkContext.defaultParallelism
    return min(wide.rdd.getNumPartitions(), max(1, math.ceil(values * 12 / worth)), most)


def solver_bytes(classes: int, width: int) -> int:
    """What the vectors of the linear solvers that run side by side take on the driver."""
    return 8 * SOLVER_VECTORS * width * min(PARALLEL_FITS, 1 if classes == 2 else classes)


def kernel_parts(wide: DataFrame, values: int) -> int:
    """Parts of kernel features: all fits share a step, whose tasks take longer to start than to multiply; so one for each core
    at most, and more only where a task would hold too many bytes."""
    worth = min(math.ceil(values * 8 / FIT_PART_BYTES), wide.sparkSession.sparkContext.defaultParallelism)
    return max(worth, math.ceil(values * 8 / KERNEL_PART_BYTES), 1)


def fit_classifier(df: DataFrame, code: str, classes: int, key: str, balanced: bool = False, width: int | None = None,
                   **options) -> Classifier:
    """Fit ``code`` on ``(key, features, label_idx)``; the rows are cached while it runs.

    Where ``terms`` of a dictionary of ``width`` words are at hand, naive Bayes and boosting read these, and so does ``l2``
    where the solvers' vectors of that width would be more than the driver holds.
    """
    trainer = algorithm(code)
    if code in READS_TERMS and TERMS in df.columns and width is not None:
        if code == "nb":
            held = df.select(LABEL, TERMS).persist(StorageLevel.MEMORY_AND_DISK)  # read twice
            try:
                return fit_term_bayes(held, classes, width)
            finally:
                held.unpersist()
        return Classifier("stumps", [], classes, stumps=boost_terms(df, LABEL, classes, options.get("rounds", 100)))
    if code == "l2" and TERMS in df.columns and width and solver_bytes(classes, width) > DRIVER_BYTES:
        return fit_terms(df, classes, width, balanced, options.get("max_iter", 100))
    wide = df.select(key, FEATURES, LABEL).persist(StorageLevel.MEMORY_AND_DISK)
    held = F.size(F.unwrap_udt(FEATURES)["values"])
    rows, values = wide.agg(F.count(F.lit(1)), F.sum(held)).first()
    if not rows:
        wide.unpersist()
        raise ValueError("nothing to fit on")
    width = wide.select(FEATURES).first()[0].size
    if code in KERNELS:  # the vectors are read once, the kernel features made of them in each step
        packed = wide.coalesce(kernel_parts(wide, rows * options.get("fourier", FOURIER)))
    else:
        packed = wide.coalesce(solver_parts(wide, values, width)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return trainer(packed, FitContext(classes, rows, width, key, balanced, options))
    finally:
        packed.unpersist()
        wide.unpersist()


# --------------------------------------------------------------------------
# a model with its features and labels
# --------------------------------------------------------------------------


@dataclass(frozen=True)
class Spec:
    """One run: which column, how it is vectorised, which algorithm."""

    feature: str = "bow"
    algorithm: str = "l2"
    weighting: str = "freq"
    balanced: bool = False

    def __post_init__(self):
        algorithm(self.algorithm)
        if self.weighting not in FEATURISERS:
            raise ValueError(f"unknown vectoriser {self.weighting!r}")
        if self.algorithm in NEEDS_COUNTS and self.weighting in ("pv", PARAGRAPHS):
            raise ValueError(f"{self.algorithm} needs non-negative features")

    @property
    def name(self) -> str:
        return f"f={self.feature}-a={self.algorithm[:9]}"


@dataclass
class Bundle:
    """Everything needed to score new notes, saved under one folder."""

    spec: Spec
    features: Features
    classifier: Classifier
    labels: list[str]
    key: str

    def transform(self, notes: DataFrame, key: str | None = None) -> DataFrame:
        """Adds ``probs``, ``prediction`` and ``pred_class``; other columns stay. ``key`` names a note."""
        key = key or self.key
        ready = with_vectors(self.features, with_feature(notes, self.spec.feature), key)
        names = F.array(*[F.lit(x) for x in self.labels])
        scored = self.classifier.transform(ready, key)
        scored = scored.withColumn("pred_class", names[F.col(PREDICTION).cast("int")])
        return scored.select(*notes.columns, PROBS, PREDICTION, "pred_class")

    def save(self, path: str, spark: SparkSession) -> None:
        tables = None
        if isinstance(self.features, PipelineModel):
            self.features.write().overwrite().save(f"{path}/features")
        else:
            tables = self.features.save(f"{path}/features")
        self.classifier.save(path, spark)
        write_json(spark, f"{path}/metadata", {"spec": asdict(self.spec), "labels": self.labels, "key": self.key, "tables": tables})

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> Bundle:
        meta = read_json(spark, f"{path}/metadata")
        if meta["tables"]:
            features = KEYED[meta["tables"]["kind"]].load(spark, f"{path}/features", meta["tables"])
        else:
            features = PipelineModel.load(f"{path}/features")
        return cls(Spec(**meta["spec"]), features, Classifier.load(path, spark), meta["labels"], meta["key"])


def with_feature(notes: DataFrame, feature: str) -> DataFrame:
    """Add ``feature_text``: a column, or several named ``a_b`` joined by a space."""
    if feature in notes.columns:
        return notes.withColumn("feature_text", F.col(feature))
    parts = feature.split("_")
    missing = [p for p in parts if p not in notes.columns]
    if missing:
        raise ValueError(f"no column {missing} for feature {feature!r}")
    return notes.withColumn("feature_text", F.concat_ws(" ", *parts))


def fit_features(train: DataFrame, spec: Spec, **options) -> Features:
    """Fit on the training notes; ``options`` of :func:`featuriser`."""
    codes = not spec.feature.startswith(("bow", "text"))
    pipe = featuriser(spec.weighting, "feature_text", codes, **options)
    return pipe.fit(with_feature(train, spec.feature))


def feature_width(features: Features) -> int | None:
    return None if isinstance(features, PipelineModel) else features.width


def fit_bundle(train: DataFrame, spec: Spec, key: str, label: str,
               features: Features | None = None, feature_options: dict | None = None, **options) -> Bundle:
    indexer = label_indexer(label).fit(train)
    labels = list(indexer.labels)
    features = features or fit_features(train, spec, key=key, label=label, **(feature_options or {}))
    ready = indexer.transform(with_vectors(features, with_feature(train, spec.feature), key))
    fitted = fit_classifier(ready, spec.algorithm, len(labels), key, spec.balanced, feature_width(features), **options)
    return Bundle(spec, features, fitted, labels, key)


# --------------------------------------------------------------------------
# reports on fitted models
# --------------------------------------------------------------------------


def history_table(spark: SparkSession, model: LogisticRegressionModel) -> DataFrame:
    """``(iteration, loss)``, one row per solver step."""
    rows = [(i, float(v)) for i, v in enumerate(model.summary.objectiveHistory)]
    return spark.createDataFrame(rows, "iteration bigint, loss double")


def _class_weights(bundle: Bundle) -> list[tuple[str, np.ndarray]]:
    """Term weights by class of linear models; of trees, one list for all classes."""
    models, kind = bundle.classifier.models, bundle.classifier.kind
    if kind == "stumps":
        values = np.zeros(bundle.features.width)
        for stump in bundle.classifier.stumps:
            values[stump.id] += stump.vote
        return [("*", values / values.sum())]
    if kind in ("one_vs_rest", "calibrated") and bundle.classifier.fourier is None:
        values = [m.coefficients.toArray() for m in models]
        return list(zip(bundle.labels, [-values[0], values[0]] if len(bundle.labels) == 2 else values))
    if hasattr(models[0], "featureImportances"):
        votes = bundle.classifier.weights or [1.0] * len(models)
        total = sum(w * m.featureImportances.toArray() for w, m in zip(votes, models))
        return [("*", total / sum(votes))]
    raise ValueError(f"{bundle.spec.algorithm} has no term weights")


def top_features(spark: SparkSession, bundle: Bundle, n: int = 20) -> DataFrame:
    """The ``n`` heaviest terms per class, over all classes for trees. Words come from the dictionary by a join.

    Linear models weigh by coefficient, boosted trees by importance times vote, naive Bayes by
    log likelihood. Equal weights go to the more frequent word.
    """
    if not isinstance(bundle.features, TableFeatures):
        raise ValueError(f"{bundle.spec.weighting!r} features have no words")
    if bundle.classifier.kind == "bayes":
        names = F.array(*[F.lit(x) for x in bundle.labels])
        floors = F.array(*[F.lit(x) for x in bundle.classifier.floors])
        rows = bundle.classifier.lifts.select("id", F.inline("lifts"))
        rows = rows.select(F.get(names, F.col("class")).alias("class"), "id", (F.col("lift") + F.get(floors, F.col("class"))).alias("weight"))
        # each task keeps its own first n of a class before anything is shuffled
        place = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("weight"), "id"))
        top = rows.withColumn("place", place.cast("bigint")).where(F.col("place") <= n)
    elif bundle.classifier.lifts is not None:
        weights = both_sides([F.col("weights")[i] for i in range(len(bundle.classifier.models))])
        pairs = [F.struct(F.lit(x).alias("class"), w.alias("weight")) for x, w in zip(bundle.labels, weights)]
        rows = bundle.classifier.lifts.select("id", F.explode(F.array(*pairs)).alias("x"))
        place = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("weight"), "id"))
        top = rows.select("id", "x.class", "x.weight").withColumn("place", place.cast("bigint")).where(F.col("place") <= n)
    else:
        best = []
        for label, values in _class_weights(bundle):
            order = np.argsort(-values, kind="stable")[:n]
            best += [(label, place + 1, int(i), float(values[i])) for place, i in enumerate(order)]
        top = spark.createDataFrame(best, "class string, place bigint, id int, weight double")
    return named(top, bundle.features.dictionary, ["class", "id"]).select("class", "place", "word", "weight")

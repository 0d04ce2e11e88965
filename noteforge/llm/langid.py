"""Language identification by string kernels.

The kernel of two texts is the blended-spectrum presence kernel: the number of
different n-grams of one, two and three bytes that both hold, divided by the root of
the product of their numbers. N-grams are runs of UTF-8 bytes of the text in lower
case, in which every run of ASCII characters other than letters is one blank; those
of three bytes are hashed to ``2 ** TRIPLE_BITS`` slots.

Training. At most ``PER_LANGUAGE`` labelled documents of each language, those whose
ids have the smallest hashes, are the training rows (the documented bound; a
language's texts may all come from one source). Some of them are Nyström landmarks.
Features are kernels to the landmarks times the inverse root of the landmarks' own
kernel; kernel ridge regression learns one language against the rest in them.

Scoring is linear in the presence of n-grams, so landmarks and weights fold into one
matrix with a row for each slot, and a batch of documents is scored as a sparse
presence matrix times that matrix. Whole texts are used.

Whether a text is in one of the learned languages at all is told by ``known``, the share of its
different three-byte n-grams that any training row has; scores can't tell, as they sum to one.
A model's ``floor`` is ``FLOOR_SHARE`` of what all but one in a hundred training rows reach when
their own n-grams are not counted: texts in other scripts, and random letters, stay below.

Defined results: null texts and texts without a letter are ``und`` with score 0.
Without a single labelled training document all are ``und``. Ties go to the language
that comes first in the alphabet. Rows are scored one by one; the input's columns are
kept, and a column named like the result is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteforge.llm.common import free_name

TRIPLE_BITS = 17
TRIPLES = 256 + 65536  # the first slot of a triple
SLOTS = TRIPLES + (1 << TRIPLE_BITS)
PER_LANGUAGE, LANDMARKS, RIDGE = 300, 400, 0.1
MAX_LANGUAGES = 1000
FLOOR_SHARE = 0.8
UNKNOWN = "und"
LANG_TYPE = "struct<lang_pred:string,score:double,known:double>"

#: Letters, and what lies beyond ASCII, stay; the rest becomes blank.
_LETTER_BYTES = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
_MAYBE_LETTER = re.compile(r"[^\W\d_]")


def letters(text: str | None) -> bytes:
    """Words in lower case between single blanks; empty without a letter."""
    if not text or not any(m.group().isalpha() for m in _MAYBE_LETTER.finditer(text)):
        return b""
    return b" " + b" ".join(text.lower().encode().translate(_LETTER_BYTES).split()) + b" "


def slots_of(text: bytes, flags: np.ndarray) -> np.ndarray:
    """The different slots of a text's n-grams: 256 for single bytes, 65,536 for pairs, the rest shared by triples.

    ``flags`` is scratch space of ``SLOTS`` false values, left as such.
    """
    if not text:
        return np.zeros(0, np.int32)
    a = np.frombuffer(text, np.uint8)
    pairs = (a[:-1].astype(np.uint16) << np.uint16(8)) | a[1:]
    triples = (pairs[:-1].astype(np.uint32) << np.uint32(8)) | a[2:]
    triples *= np.uint32(0x9E3779B1)
    triples >>= np.uint32(32 - TRIPLE_BITS)
    flags[:256][a] = True
    flags[256 : 256 + 65536][pairs] = True
    flags[TRIPLES:][triples] = True
    found = np.flatnonzero(flags)
    flags[found] = False
    return found.astype(np.int32)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray  # SLOTS x languages
    bias: np.ndarray
    seen: np.ndarray  # which slots of triples any training row has
    floor: float = 0.0

    def known(self, slots: np.ndarray) -> float:
        """Share of a text's triples that training rows have; 1 for a text without one."""
        triples = slots[slots >= TRIPLES] - TRIPLES
        return float(self.seen[triples].mean()) if len(triples) else 1.0

    def scores(self, presence: Sequence[np.ndarray]) -> np.ndarray:
        """One row per text: presence matrix times weights, each row divided by the root of its n-grams."""
        sizes = np.array([len(p) for p in presence])
        out = np.zeros((len(presence), len(self.languages)))
        used = sizes > 0
        if used.any():
            rows = self.weights[np.concatenate([p for p in presence if len(p)])]
            starts = np.concatenate([[0], np.cumsum(sizes[used])[:-1]])
            out[used] = np.add.reduceat(rows, starts, axis=0) / np.sqrt(sizes[used])[:, None]
        return out + self.bias


def kernel(a: Sequence[np.ndarray], b: Sequence[np.ndarray]) -> np.ndarray:
    """Presence kernel of every text of ``a`` with every one of ``b``, by batched matrix products."""
    used = np.unique(np.concatenate([*b, np.zeros(0, np.int32)]))

    def dense(texts: Sequence[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(texts), len(used)), np.float32)
        for i, t in enumerate(texts):
            at = np.searchsorted(used, t)
            ok = at < len(used)
            ok[ok] = used[at[ok]] == t[ok]
            out[i, at[ok]] = 1
        return out

    right = dense(b).T
    out = np.concatenate([dense(a[i : i + 128]) @ right for i in range(0, len(a), 128)]).astype(np.float64)
    return out / np.sqrt(np.outer([max(1, len(t)) for t in a], [max(1, len(t)) for t in b]))


def fit(presence: Sequence[np.ndarray], langs: Sequence[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Nyström features and one-versus-rest ridge regression; targets are 1 and 0."""
    languages = tuple(sorted(set(langs)))
    if not languages:
        return Model((), np.zeros((SLOTS, 0)), np.zeros(0), np.zeros(SLOTS - TRIPLES, bool))
    step = max(1, -(-len(presence) // landmarks))
    marks = list(presence[::step])
    to_marks, own = kernel(presence, marks), kernel(marks, marks)
    values, vectors = np.linalg.eigh(own)
    good = values > 1e-8 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    x = to_marks @ root
    y = np.array([[float(one == lang) for one in languages] for lang in langs])
    mean_x, mean_y = x.mean(axis=0), y.mean(axis=0)
    xc = x - mean_x
    w = np.linalg.solve(xc.T @ xc + ridge * np.eye(x.shape[1]), xc.T @ (y - mean_y))
    per_mark = root @ w
    weights = np.zeros((SLOTS, len(languages)))
    for m, row in zip(marks, per_mark):
        weights[m] += row / np.sqrt(max(1, len(m)))
    rows = np.bincount(np.concatenate([p[p >= TRIPLES] - TRIPLES for p in presence]), minlength=SLOTS - TRIPLES)
    shares = [(rows[p[p >= TRIPLES] - TRIPLES] > 1).mean() for p in presence if (p >= TRIPLES).any()]
    floor = FLOOR_SHARE * float(np.quantile(shares, 0.01)) if shares else 0.0
    return Model(languages, weights, mean_y - mean_x @ w, rows > 0, floor)


def presence_udf():
    @F.arrow_udf("binary")
    def presence(texts: pa.Array) -> pa.Array:
        flags = np.zeros(SLOTS, bool)
        return pa.array([slots_of(letters(t), flags).tobytes() for t in texts.to_pylist()], pa.binary())

    return presence


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Fit on a bounded sample of the labelled rows of ``docs``; only text and label are learned from."""
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.xxhash64(key).alias("h"), F.col(text).alias("text")
    )
    names = [r[0] for r in labelled.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect()]
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    # the smallest hashes of a language, first within slices of it and then among their winners
    narrow = labelled.select("lang", "h").distinct().withColumn("slice", F.pmod("h", F.lit(16)))
    for keys in (["lang", "slice"], ["lang"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("h"))
        narrow = narrow.withColumn("place", place).where(F.col("place") <= per_language)
    edges = {r["lang"]: r["edge"] for r in narrow.groupBy("lang").agg(F.max("h").alias("edge")).collect()}
    if not edges:
        return fit([], [])
    inside = F.lit(False)
    for name in sorted(edges):
        inside = inside | ((F.col("lang") == name) & (F.col("h") <= edges[name]))
    rows = labelled.where(inside).groupBy("lang", "h").agg(F.min("text").alias("text"))
    rows = rows.select("lang", "h", presence_udf()("text").alias("p")).collect()  # per_language rows for each language
    seen = [(r["lang"], r["h"], np.frombuffer(r["p"], np.int32)) for r in rows]
    seen = sorted((x for x in seen if len(x[2])), key=lambda x: (x[1], x[0]))
    return fit([x[2] for x in seen], [x[0] for x in seen])


def language_udf(sent):
    """``struct(lang_pred, score, known)`` of a text column, with a broadcast model."""

    @F.arrow_udf(LANG_TYPE)
    def language(texts: pa.Array) -> pa.Array:
        model, flags = sent.value, np.zeros(SLOTS, bool)
        names, scores, known = [], [], []
        values = texts.to_pylist()
        for at in range(0, len(values), 64):
            presence = [slots_of(letters(t), flags) for t in values[at : at + 64]]
            known += [model.known(p) for p in presence]
            if not model.languages:
                names += [UNKNOWN] * len(presence)
                scores += [0.0] * len(presence)
                continue
            s = model.scores(presence)
            for p, row in zip(presence, s):
                i = int(row.argmax())
                names.append(model.languages[i] if len(p) else UNKNOWN)
                scores.append(float(min(1.0, max(0.0, row[i]))) if len(p) else 0.0)
        columns = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(known, pa.float64())]
        return pa.StructArray.from_arrays(columns, ["lang_pred", "score", "known"])

    return language


def identify(docs: DataFrame, model: Model, text: str = "text") -> Column:
    return language_udf(docs.sparkSession.sparkContext.broadcast(model))(F.col(text))


def with_language(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score``. A projection: no shuffle."""
    own = free_name(docs, "_language")
    df = docs.withColumn(own, identify(docs, model, text))
    return df.withColumns({"lang_pred": F.col(f"{own}.lang_pred"), "score": F.col(f"{own}.score")}).drop(own)

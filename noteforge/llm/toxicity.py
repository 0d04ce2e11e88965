"""Toxicity by a bidirectional gated recurrent network with attention pooling.

Words are runs of ASCII letters, digits and bytes beyond ASCII, in lower case. The input
of a word is its own vector (one vector for all words not in the dictionary) beside the
mean of the vectors of its characters' trigrams (hashed to ``TRIGRAMS`` slots, blanks at
both ends). A window is ``WINDOW`` words. Two gated recurrent units read it, forwards and
backwards; attention weighs their states, and one output unit gives the window's logit.
Every text is cut into windows that overlap by half, the last one ending with the text;
its logit is that of its worst window, and a sigmoid fitted on documents set aside turns
it into the score.

Training is in numpy (gradients by hand, Adam), on a documented bounded sample: of each
class, the ``PER_CLASS`` documents of at most ``LONGEST`` bytes whose ids have the smallest
hashes. Labels belong to documents, not to windows: the first pass takes all windows with
their document's label, later ones the worst windows of a document by the network so far
and, of clean documents, as many others. The pass with the least loss on the documents set
aside (one in five, by hash) is kept.

Scoring is a projection with the network as a broadcast (at most ``MAX_WORDS`` words and
``TRIGRAMS`` slots). Input products of words are remembered in a worker up to a bound, and
windows of many documents go through the network together.

Defined results: null texts and texts without a word get the share of label 1 among the
labelled documents. Without labels that share is 0; with labels of one class only, every
text gets it. Null labels and null ids teach nothing; a document with several labels has
the largest; of unequal texts under one id, the least one teaches. Rows are scored one by
one; the input's columns are kept, and a column named like the result is replaced.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteforge.llm.common import free_name
from noteforge.llm.leaks import WORD_BYTES

WINDOW, STRIDE = 32, 16
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 16, 16, 16, 16
TRIGRAMS = 1 << 12
MAX_WORDS, LEAST_DOCS = 30_000, 3
PER_CLASS, LONGEST = 1000, 32_768
PASSES, BATCH, RATE, DECAY, FORGET = 5, 128, 0.01, 1e-5, 0.15
LEAST_STEPS = 400  # small samples are passed over more often, until so many steps are made
WORST = 3  # windows of a document that teach in later passes
SEED = 7
THRESHOLD = 0.3
TOGETHER = 1024  # windows that go through the network at once when scoring
TOKENS = 150_000  # words of documents that are scored together
REMEMBERED = 60_000  # words whose input products a worker keeps
RESET, UPDATE, FRESH = 0, 1, 2
CLOSED = 60.0  # update gate of a place without a word: the state passes unchanged

Params = dict[str, np.ndarray]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(WORD_BYTES).split()


def trigrams(words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the trigrams centred on each byte of the words, and the words' lengths."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    a = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    codes = ((a[:-2] << np.uint32(16)) | (a[1:-1] << np.uint32(8)) | a[2:]) * np.uint32(0x9E3779B1)
    return (codes[a[1:-1] != 32] >> np.uint32(32 - int(math.log2(TRIGRAMS)))).astype(np.int64), lengths


def windows_of(n: int, stride: int = STRIDE) -> np.ndarray:
    """First places of the windows of a text of ``n`` words."""
    if n <= WINDOW:
        return np.zeros(min(n, 1), np.int64)
    return np.unique(np.append(np.arange(0, n - WINDOW, stride), n - WINDOW))


# --- the network ---------------------------------------------------------------


def new_params(words: int, seed: int = SEED, kind: type = np.float32) -> Params:
    rng = np.random.default_rng(seed)

    def normal(*shape: int) -> np.ndarray:
        return (rng.normal(size=shape) / math.sqrt(shape[-2] if len(shape) > 1 else shape[0])).astype(kind)

    inputs = WORD_DIM + CHAR_DIM
    return {
        "word": (0.1 * rng.normal(size=(words + 1, WORD_DIM))).astype(kind),
        "char": (0.3 * rng.normal(size=(TRIGRAMS, CHAR_DIM))).astype(kind),
        "in": normal(3, 2, inputs, HIDDEN), "in_bias": np.zeros((3, 2, HIDDEN), kind),
        "state": normal(3, 2, HIDDEN, HIDDEN),
        "look": normal(2 * HIDDEN, ATTENTION), "look_bias": np.zeros(ATTENTION, kind), "weigh": normal(ATTENTION),
        "out": normal(2 * HIDDEN), "out_bias": np.zeros(1, kind),
    }


def inputs_of(p: Params, ids: np.ndarray, grams: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Word vector beside the mean trigram vector, a row for each word."""
    if not len(ids):
        return np.zeros((0, WORD_DIM + CHAR_DIM), p["word"].dtype)
    chars = np.add.reduceat(p["char"][grams], np.cumsum(lengths) - lengths, axis=0) / lengths[:, None].astype(p["word"].dtype)
    return np.concatenate([p["word"][ids], chars], axis=1)


def products(p: Params, x: np.ndarray) -> np.ndarray:
    """``(gate, unit, words + 1, HIDDEN)``: what the words give to both units; row 0 stands for no word."""
    out = np.zeros((3, 2, len(x) + 1, HIDDEN), x.dtype)
    out[:, :, 1:] = x @ p["in"] + p["in_bias"][:, :, None]
    out[UPDATE, :, 0] = CLOSED
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-x))


def _gates(x: np.ndarray) -> np.ndarray:
    """Sigmoid in place."""
    np.negative(x, out=x)
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def forward(p: Params, table: np.ndarray, at: np.ndarray, keep: bool = False):
    """Logits of windows; ``at`` (windows, WINDOW) are rows of ``table``. With ``keep`` also what :func:`backward` needs."""
    n, width = at.shape
    kind, places = table.dtype, np.ascontiguousarray(at.T)
    both = np.empty((width, n, 2 * HIDDEN), kind)
    h, steps = np.zeros((2, n, HIDDEN), kind), []
    x = np.empty((3, 2, n, HIDDEN), kind)
    for t in range(width):
        for gate in (RESET, UPDATE, FRESH):
            np.take(table[gate, 0], places[t], axis=0, out=x[gate, 0], mode="clip")
            np.take(table[gate, 1], places[width - 1 - t], axis=0, out=x[gate, 1], mode="clip")
        s = h @ p["state"]
        gates = _gates(x[:FRESH] + s[:FRESH])
        fresh = np.tanh(x[FRESH] + gates[RESET] * s[FRESH])
        if keep:
            steps.append((h, gates[RESET], gates[UPDATE], fresh, s[FRESH]))
        h = fresh + gates[UPDATE] * (h - fresh)
        both[t, :, :HIDDEN], both[width - 1 - t, :, HIDDEN:] = h[0], h[1]
    flat = both.reshape(width * n, 2 * HIDDEN)
    look = np.tanh(flat @ p["look"] + p["look_bias"])
    weight = (look @ p["weigh"][:, None]).reshape(width, n)
    weight[places == 0] = -np.inf
    weight -= weight.max(axis=0)
    np.exp(weight, out=weight)
    weight /= weight.sum(axis=0)
    value = (flat @ p["out"][:, None]).reshape(width, n)
    logit = (weight * value).sum(axis=0) + p["out_bias"][0]
    return (logit, (both, look.reshape(width, n, ATTENTION), weight, value, steps)) if keep else logit


def backward(p: Params, table: np.ndarray, at: np.ndarray, logit: np.ndarray, kept, d_logit: np.ndarray) -> tuple[Params, np.ndarray]:
    """Gradients of the parameters behind the table, and of the table."""
    both, look, weight, value, steps = kept
    n, width = at.shape
    g = {k: np.zeros_like(p[k]) for k in ("state", "look", "look_bias", "weigh", "out", "out_bias")}
    g["out_bias"][0] = d_logit.sum()
    d_value = weight * d_logit
    d_weight = weight * (value - (logit - p["out_bias"][0])) * d_logit
    flat = both.reshape(width * n, 2 * HIDDEN)
    g["out"] = d_value.ravel() @ flat
    g["weigh"] = d_weight.ravel() @ look.reshape(width * n, ATTENTION)
    d_look = d_weight[:, :, None] * p["weigh"] * (1 - look * look)
    g["look_bias"] = d_look.sum(axis=(0, 1))
    g["look"] = flat.T @ d_look.reshape(width * n, ATTENTION)
    d_both = d_value[:, :, None] * p["out"] + d_look @ p["look"].T
    d_table = np.zeros((3, 2, n, width, HIDDEN), table.dtype)
    dh = np.zeros((2, n, HIDDEN), table.dtype)
    back = p["state"].transpose(0, 1, 3, 2)
    for t in range(width - 1, -1, -1):
        h, reset, update, fresh, s_fresh = steps[t]
        dh = dh + np.stack([d_both[t, :, :HIDDEN], d_both[width - 1 - t, :, HIDDEN:]])
        d_fresh = dh * (1 - update) * (1 - fresh * fresh)
        d_in = np.stack([d_fresh * s_fresh * reset * (1 - reset), dh * (h - fresh) * update * (1 - update), d_fresh])
        d_table[:, 0, :, t], d_table[:, 1, :, width - 1 - t] = d_in[:, 0], d_in[:, 1]
        d_in[FRESH] *= reset
        g["state"] += h.transpose(0, 2, 1) @ d_in
        dh = dh * update + (d_in @ back).sum(axis=0)
    out = np.zeros_like(table)
    rows = d_table.reshape(3, 2, n * width, HIDDEN)
    order = np.argsort(at.ravel(), kind="stable")
    found, starts = np.unique(at.ravel()[order], return_index=True)
    out[:, :, found] = np.add.reduceat(rows[:, :, order], starts, axis=2)
    out[:, :, 0] = 0
    return g, out


def input_gradients(p: Params, ids: np.ndarray, grams: np.ndarray, lengths: np.ndarray, x: np.ndarray, d_table: np.ndarray) -> Params:
    """Gradients of the parameters in front of the table (rows from 1 are the words)."""
    d = d_table[:, :, 1:]
    g = {"in": x.T @ d, "in_bias": d.sum(axis=2)}
    dx = (d @ p["in"].transpose(0, 1, 3, 2)).sum(axis=(0, 1))
    g["word"] = np.zeros_like(p["word"])
    np.add.at(g["word"], ids, dx[:, :WORD_DIM])
    g["char"] = np.zeros_like(p["char"])
    np.add.at(g["char"], grams, np.repeat(dx[:, WORD_DIM:] / lengths[:, None].astype(dx.dtype), lengths, axis=0))
    return g


class Adam:
    def __init__(self, p: Params, rate: float = RATE, decay: float = DECAY):
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
        self.step, self.rate, self.decay = 0, rate, decay

    def apply(self, p: Params, g: Params) -> None:
        self.step += 1
        norm = math.sqrt(sum(float((x * x).sum()) for x in g.values()))
        for k, x in g.items():
            x = x * min(1.0, 5.0 / (norm + 1e-9))
            self.m[k] += 0.1 * (x - self.m[k])
            self.v[k] += 0.01 * (x * x - self.v[k])
            size = self.rate * math.sqrt(1 - 0.99**self.step) / (1 - 0.9**self.step)
            p[k] -= size * self.m[k] / (np.sqrt(self.v[k]) + 1e-7) + self.rate * self.decay * p[k]


# --- training ------------------------------------------------------------------


@dataclass
class Model:
    """A trained network; without parameters every text gets ``share``."""

    share: float
    words: dict[bytes, int] = field(default_factory=dict)
    params: Params | None = None
    slope: float = 1.0
    shift: float = 0.0


@dataclass(frozen=True)
class _Taught:
    """Windows of the training documents as rows of the table of all their words."""

    at: np.ndarray
    of_doc: np.ndarray
    ids: np.ndarray
    grams: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray

    def table(self, p: Params, types: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Products of the words ``types``, and the inputs they come from."""
        lengths = self.lengths[types]
        place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        grams = self.grams[np.repeat(self.starts[types], lengths) + place]
        x = inputs_of(p, known, grams, lengths)
        return products(p, x), x, grams, lengths


def _prepare(texts: Sequence[list[bytes]], words: dict[bytes, int]) -> _Taught:
    types = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
    at, of_doc = [], []
    for d, t in enumerate(texts):
        row = np.zeros(max(len(t), WINDOW), np.int64)
        row[: len(t)] = [types[w] + 1 for w in t]
        first = windows_of(len(t), WINDOW)
        at.append(row[first[:, None] + np.arange(WINDOW)])
        of_doc.append(np.full(len(first), d))
    names = list(types)
    grams, lengths = trigrams(names) if names else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    ids = np.array([words.get(w, 0) for w in names], np.int64)
    nothing = np.zeros((0, WINDOW), np.int64)
    return _Taught(np.concatenate([nothing, *at]), np.concatenate([np.zeros(0, np.int64), *of_doc]), ids, grams, np.cumsum(lengths) - lengths, lengths)


def _logits(p: Params, taught: _Taught, which: np.ndarray) -> np.ndarray:
    table = taught.table(p, np.arange(len(taught.ids)), taught.ids)[0]
    parts = [forward(p, table, taught.at[which[i : i + TOGETHER]]) for i in range(0, len(which), TOGETHER)]
    return np.concatenate([np.zeros(0, np.float32), *parts])


def _platt(logit: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a sigmoid by Newton's method, held near (1, 0)."""
    a = np.array([1.0, 0.0])
    x = np.stack([logit, np.ones(len(logit))], axis=1).astype(np.float64)
    for _ in range(50):
        q = _sigmoid(x @ a)
        g = x.T @ (weight * (q - y)) + 0.05 * (a - [1.0, 0.0])
        h = (x * (weight * q * (1 - q))[:, None]).T @ x + 0.05 * np.eye(2)
        a = a - np.clip(np.linalg.solve(h, g), -1, 1)
    return max(float(a[0]), 0.05), float(a[1])


def fit(texts: Sequence[str | None], labels: Sequence[int], share: float, passes: int = PASSES, steps: int = LEAST_STEPS, seed: int = SEED) -> Model:
    """Train on documents with labels 0 and 1; ``share`` is the share of label 1 outside the sample."""
    split = [(words_of(t), y) for t, y in zip(texts, labels)]
    split = [(w, y) for w, y in split if w]
    y = np.array([y for _, y in split], np.float64)
    if len(set(y)) < 2:
        return Model(share)
    seen = Counter(w for t, _ in split for w in set(t))
    common = sorted((w for w, n in seen.items() if n >= LEAST_DOCS), key=lambda w: (-seen[w], w))[:MAX_WORDS]
    words = {w: i + 1 for i, w in enumerate(common)}
    taught = _prepare([t for t, _ in split], words)
    aside = np.array([zlib.crc32(b" ".join(t)) % 5 == 0 for t, _ in split])
    if len(set(y[~aside])) < 2 or len(set(y[aside])) < 2:
        aside = np.zeros(len(split), bool)
    p, rng = new_params(len(words), seed), np.random.default_rng(seed)
    solver, best = Adam(p), (math.inf, p, np.zeros(0))
    of_doc, checked = taught.of_doc, aside if aside.any() else ~aside
    mine = np.flatnonzero(~aside[of_doc])
    n_pos = y[checked].sum()
    weight = np.where(y[checked] == 1, share / max(n_pos, 1), (1 - share) / max(checked.sum() - n_pos, 1)) * checked.sum()

    def worst(logit: np.ndarray) -> np.ndarray:
        """The largest logit of every document."""
        out = np.full(len(y), -np.inf)
        np.maximum.at(out, of_doc, logit)
        return out

    logits, turn = np.zeros(0), 0
    while turn < passes or solver.step < steps:
        pick = mine
        if turn:
            logit = logits[mine]
            order = np.lexsort((-logit, of_doc[mine]))
            docs = of_doc[mine][order]
            new = np.concatenate([[True], docs[1:] != docs[:-1]])
            place = np.arange(len(docs)) - np.maximum.accumulate(np.where(new, np.arange(len(docs)), 0))
            hard = mine[order[place < WORST]]
            clean = mine[order[(place >= WORST) & (y[docs] == 0)]]
            other = rng.permutation(clean)[: len(hard)]
            pick = np.concatenate([hard, other])
        pick = rng.permutation(pick)
        own = y[of_doc[pick]]
        balance = np.where(own == 1, 0.5 / max(own.mean(), 1e-6), 0.5 / max(1 - own.mean(), 1e-6))
        for i in range(0, len(pick), BATCH):
            some = pick[i : i + BATCH]
            types, at = np.unique(taught.at[some], return_inverse=True)
            at = at.reshape(len(some), WINDOW)
            if types[0] != 0:
                at = at + 1
            types = types[types != 0] - 1
            known = np.where(rng.random(len(types)) < FORGET, 0, taught.ids[types])
            table, x, grams, lengths = taught.table(p, types, known)
            logit, kept = forward(p, table, at, keep=True)
            d = ((_sigmoid(logit) - own[i : i + BATCH]) * balance[i : i + BATCH] / len(some)).astype(np.float32)
            g, d_table = backward(p, table, at, logit, kept, d)
            solver.apply(p, g | input_gradients(p, known, grams, lengths, x, d_table))
        turn += 1
        logits = _logits(p, taught, np.arange(len(of_doc)))
        top = worst(logits)
        slope, shift = _platt(top[checked], y[checked], weight)
        q = np.clip(_sigmoid(slope * top[checked] + shift), 1e-6, 1 - 1e-6)
        loss = float((weight * -(y[checked] * np.log(q) + (1 - y[checked]) * np.log(1 - q))).mean())
        if loss < best[0]:
            best = (loss, {k: v.copy() for k, v in p.items()}, np.array([slope, shift]))
    return Model(share, words, best[1], float(best[2][0]), float(best[2][1]))


def train(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
    per_class: int = PER_CLASS, longest: int = LONGEST,
) -> Model:
    """Fit on a bounded sample of the labelled rows of ``docs``; only text and label are learned from."""
    marks = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.max(label).cast("int").alias("y"))
    marks = marks.select(F.col(doc_id).alias("id"), "y")
    fit_rows = docs.where(F.col(text).isNotNull() & (F.octet_length(text) <= longest)).select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    known = marks.join(docs.select(F.col(doc_id).alias("id")), "id", "left_semi")
    ones, total = known.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count(F.lit(1))).first()
    share = ones / total if total else 0.0
    ids = marks.join(fit_rows.select("id"), "id", "left_semi").withColumn("h", F.xxhash64("id"))
    firsts = [ids.where(F.col("y") == y).orderBy("h", "id").limit(per_class) for y in (0, 1)]
    chosen = F.broadcast(firsts[0].unionByName(firsts[1]).select("id", "y", "h"))  # 2 * per_class ids
    rows = fit_rows.join(chosen, "id").groupBy("h", "id").agg(F.min("y").alias("y"), F.min("text").alias("text")).collect()
    rows = sorted(rows, key=lambda r: (r["h"], r["id"]))
    return fit([r["text"] for r in rows], [r["y"] for r in rows], share)


# --- scoring -------------------------------------------------------------------


class Scorer:
    """Scores texts with one model; remembers input products of words."""

    def __init__(self, model: Model):
        self.model = model
        self.rows: dict[bytes, int] = {}
        if model.params:
            self.table = np.zeros((3, 2, REMEMBERED + 1, HIDDEN), np.float32)
            self.table[:, :, :1] = products(model.params, np.zeros((0, WORD_DIM + CHAR_DIM), np.float32))

    @property
    def room(self) -> int:
        return self.table.shape[2] - 1

    def _learn(self, words: set[bytes]) -> None:
        new = sorted(words)
        if len(self.rows) + len(new) > self.room:
            self.rows.clear()
            if len(new) > self.room:
                self.table = np.concatenate([self.table[:, :, :1], np.zeros((3, 2, len(new), HIDDEN), np.float32)], axis=2)
        if new:
            grams, lengths = trigrams(new)
            ids = np.array([self.model.words.get(w, 0) for w in new], np.int64)
            first = len(self.rows) + 1
            own = products(self.model.params, inputs_of(self.model.params, ids, grams, lengths))
            self.table[:, :, first : first + len(new)] = own[:, :, 1:]
            self.rows.update(zip(new, range(first, first + len(new))))

    def _scores(self, texts: list[list[bytes]]) -> list[float]:
        present = {w for t in texts for w in t}
        missing = present - self.rows.keys()
        if len(self.rows) + len(missing) > self.room:
            missing = present  # all anew
        self._learn(missing)
        sizes = np.array([len(t) for t in texts], np.int64)
        at = np.fromiter((self.rows[w] for t in texts for w in t), np.int64, int(sizes.sum()))
        at = np.concatenate([at, np.zeros(WINDOW, np.int64)])
        firsts = [windows_of(n) for n in sizes.tolist()]
        counts = np.array([len(f) for f in firsts])
        start, size = np.repeat(np.cumsum(sizes) - sizes, counts), np.repeat(sizes, counts)
        place = np.concatenate([np.zeros(0, np.int64), *firsts])[:, None] + np.arange(WINDOW)
        index = np.where(place < size[:, None], start[:, None] + place, len(at) - 1)
        logits = np.concatenate([forward(self.model.params, self.table, at[index[i : i + TOGETHER]]) for i in range(0, len(index), TOGETHER)])
        top = np.maximum.reduceat(logits, np.cumsum(counts) - counts).astype(np.float64)
        return _sigmoid(self.model.slope * top + self.model.shift).tolist()

    def __call__(self, texts: Sequence[str | None]) -> list[float]:
        out = [self.model.share] * len(texts)
        if not self.model.params:
            return out
        where: list[int] = []
        held: list[list[bytes]] = []
        size = 0
        for i, text in enumerate(texts):
            words = words_of(text)
            if words:
                where.append(i)
                held.append(words)
                size += len(words)
            if held and (size >= TOKENS or i == len(texts) - 1):
                for j, score in zip(where, self._scores(held)):
                    out[j] = score
                where, held, size = [], [], 0
        for j, score in zip(where, self._scores(held) if held else []):
            out[j] = score
        return out


def with_toxicity(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add ``score`` and ``predicted`` (1 from the threshold on). A projection: no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def toxicity(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(sent.value)
        for texts in batches:
            yield pa.array(scorer(texts.to_pylist()), pa.float64())

    own = free_name(docs, "_toxicity")
    df = docs.withColumn(own, toxicity(F.col(text)))
    return df.withColumns({"score": F.col(own), "predicted": (F.col(own) >= threshold).cast("int")}).drop(own)

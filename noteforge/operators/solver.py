"""Iterative fits over tables: small parameters on the driver, sums of gradients over the rows.

An objective gives the loss and its gradient at some parameters, as sums over the rows of a
staged table; tasks add up their rows, and one aggregate by place adds up the tasks. The
solver keeps its state (parameters, curvature pairs, history), so that it can be stopped and
taken up again, and judges each step on validation rows.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEMORY = 8  # curvature pairs
HALVINGS = 12
RowsLoss = Callable[[pa.RecordBatch, np.ndarray], tuple[float, np.ndarray]]
Walk = Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]  # yields parameters, is sent their loss and slope


def summed(rows: DataFrame, loss: RowsLoss, params: np.ndarray, gradient: bool = True) -> tuple[float, np.ndarray]:
    """Loss and gradient summed over all rows; ``loss`` does so for a batch of them."""
    size = len(params) if gradient else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + size)
        for batch in batches:
            value, slope = loss(batch, params)
            total[0] += value
            total[1:] += slope[:size]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["place", "value"])

    # a row for each task and place; partial sums keep the tasks' places apart from the driver
    sums = rows.mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value"))
    out = np.zeros(1 + size)
    for place, value in sums.collect():  # as many rows as parameters
        out[place] = value
    return float(out[0]), out[1:]


@dataclass
class State:
    """Where a solver stands. ``history`` has (step, loss, validation loss)."""

    params: np.ndarray
    pairs: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    history: list[tuple[int, float, float]] = field(default_factory=list)
    best: np.ndarray | None = None
    best_step: int = 0
    stopped: bool = False


def direction(slope: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Limited-memory quasi-Newton direction from pairs (step, change of the gradient)."""
    q, kept = slope.copy(), []
    for s, y in reversed(pairs):
        a = (s @ q) / (s @ y)
        kept.append(a)
        q -= a * y
    if pairs:
        s, y = pairs[-1]
        q *= (s @ y) / (y @ y)
    for (s, y), a in zip(pairs, reversed(kept)):
        q += s * (a - (y @ q) / (s @ y))
    return -q


def improve(
    state: State, loss: Callable[[np.ndarray], tuple[float, np.ndarray]], judge: Callable[[np.ndarray], float] | None = None,
    steps: int = 50, patience: int = 3, tolerance: float = 1e-6, least_gain: float = 0.0,
) -> State:
    """At most ``steps`` more steps, until the loss stands still or ``patience`` steps brought the validation loss no gain.

    Without ``judge`` the loss itself is judged. The best parameters seen are in ``best``.
    """
    judge = judge or (lambda p: loss(p)[0])
    value, slope = loss(state.params)
    if not state.history:
        state.history.append((0, value, judge(state.params)))
        state.best = state.params.copy()
    for _ in range(steps):
        if state.stopped:
            break
        way = direction(slope, state.pairs)
        if way @ slope >= 0:  # no way down: forget the curvature
            state.pairs, way = [], -slope
        size = 1.0 if state.pairs else min(1.0, 1.0 / max(np.abs(slope).sum(), 1e-12))
        for _ in range(HALVINGS):
            new = state.params + size * way
            new_value, new_slope = loss(new)
            if new_value <= value + 1e-4 * size * (way @ slope):
                break
            size /= 2
        else:
            state.stopped = True
            break
        s, y = new - state.params, new_slope - slope
        if s @ y > 1e-12:
            state.pairs = [*state.pairs[-MEMORY + 1 :], (s, y)]
        gain, state.params, value, slope = value - new_value, new, new_value, new_slope
        step = state.history[-1][0] + 1
        state.history.append((step, value, judge(new)))
        lowest = min(v for k, _, v in state.history if k <= state.best_step)
        if state.history[-1][2] < lowest - least_gain:
            state.best, state.best_step = new.copy(), step
        if step - state.best_step >= patience or gain <= tolerance * max(abs(value), 1.0):
            state.stopped = True
    return state


# --- walks that share their passes ------------------------------------------------


SEARCHES = 20  # steps of a line search
GROW, ARMIJO, WOLFE, LEAST = 2.1, 1e-4, 0.9, 1e-10
SEEN = 20  # losses that a walk looks back on


def together(walks: list[Walk], losses: Callable[[list[int], list[np.ndarray]], list[tuple[float, np.ndarray]]]) -> list[np.ndarray]:
    """Where the walks end. What all of them ask for is found at once: ``losses`` gets their numbers and parameters."""
    asked, ends = {i: next(walk) for i, walk in enumerate(walks)}, [np.zeros(0)] * len(walks)
    while asked:
        ids = list(asked)
        for i, found in zip(ids, losses(ids, list(asked.values()))):
            try:
                asked[i] = walks[i].send(found)
            except StopIteration as end:
                ends[i] = end.value
                del asked[i]
    return ends


def signed_steps(params: np.ndarray, steps: int, tolerance: float, memory: int = 10) -> Walk:
    """At most ``steps`` quasi-Newton steps, in each of which a parameter may reach zero but not cross it.

    For losses with kinks, with the same steps and stops as the margin machines of ``pyspark.ml``: until
    the loss is near the worst of the last twenty, or the slope is small, or a search fails twice in a row.
    """
    value, slope = yield params
    first, seen, pairs, step, failed = value, [], [], 0, False
    while step < steps and np.linalg.norm(slope) > max(tolerance * abs(value), 1e-8):
        if len(seen) == SEEN and abs(value - max(seen)) <= tolerance * abs(first):
            break
        way = direction(slope, pairs) if not pairs or pairs[-1][0] @ pairs[-1][1] > 0 else np.full_like(slope, np.nan)
        way = np.where(way * slope < 0, way, np.where(np.isnan(way), way, 0.0))
        side = np.where(params != 0, np.sign(params), np.sign(-slope))
        size, shrink = (1.0, 0.5) if step else (0.5 / np.linalg.norm(slope), 0.1)
        found = (yield from _searched(params, value, slope, way, side, size, shrink)) if np.isfinite(way).all() else None
        if found is None:
            if failed:
                break
            failed, pairs = True, []
            continue
        new, new_value, new_slope = found
        pairs = [*pairs[-memory + 1 :], (new - params, new_slope - slope)]
        params, value, slope, failed, step = new, new_value, new_slope, False, step + 1
        seen = [*seen[-SEEN + 1 :], value]
    return params


def _searched(params: np.ndarray, value: float, slope: np.ndarray, way: np.ndarray, side: np.ndarray, size: float, shrink: float):
    """Parameters along ``way`` with their loss and slope, shrinking and growing the step; None if it gets too small."""
    down = way @ slope

    def at(size: float) -> np.ndarray:
        new = params + way * size
        return np.where(np.sign(new) == side, new, 0.0)

    # the first step is shrunk wherever the way leads down, so its loss isn't asked for
    low, found = value, None
    for search in range(SEARCHES):
        if low > value + size * down * ARMIJO:
            times = shrink
        else:
            if found is None:
                found = (at(size), *(yield at(size)))
            steep = found[2] @ way
            times = GROW if steep < WOLFE * down else shrink if steep > -WOLFE * down else 1.0
        if times == 1.0 or search == SEARCHES - 1:
            break
        size *= times
        if size < LEAST:
            return None
        found = (at(size), *(yield at(size)))
        low = found[1]
    return found


def history_table(spark: SparkSession, state: State) -> DataFrame:
    """``(iteration, loss, validation, kept)``, one row a step; ``kept`` marks the parameters that stay."""
    rows = [(k, float(a), float(b), k == state.best_step) for k, a, b in state.history]
    return spark.createDataFrame(rows, "iteration bigint, loss double, validation double, kept boolean")


# --- softmax regression on dense vectors ------------------------------------------


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def matrix_of(column: pa.Array, width: int) -> np.ndarray:
    """A column of lists of equal length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def softmax_loss(classes: int, width: int) -> RowsLoss:
    """Cross entropy of rows ``(y, x)``; parameters are a row of weights and a bias for each class."""

    def loss(batch: pa.RecordBatch, params: np.ndarray) -> tuple[float, np.ndarray]:
        y, x = batch.column(0).to_numpy().astype(int), matrix_of(batch.column(1), width)
        w = params.reshape(classes, width + 1)
        p = softmax(x @ w[:, :width].T + w[:, width])
        value = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum()
        p[np.arange(len(y)), y] -= 1
        return float(value), np.concatenate([p.T @ x, p.sum(axis=0)[:, None]], axis=1).ravel()

    return loss


def fit_softmax(
    rows: DataFrame, classes: int, width: int, check: DataFrame | None = None, l2: float = 1e-4, state: State | None = None, **options
) -> State:
    """Softmax regression on ``(y, x)``, judged on the rows ``check``; mean losses, penalty on the weights."""
    loss, n = softmax_loss(classes, width), max(rows.count(), 1)
    weigh = np.concatenate([np.ones((classes, width)), np.zeros((classes, 1))], axis=1).ravel() * l2

    def value(p: np.ndarray) -> tuple[float, np.ndarray]:
        total, slope = summed(rows, loss, p)
        return total / n + 0.5 * float(weigh @ (p * p)), slope / n + weigh * p

    m = max(check.count(), 1) if check is not None else 0
    judge = (lambda p: summed(check, loss, p, gradient=False)[0] / m) if check is not None else None
    return improve(state or State(np.zeros(classes * (width + 1))), value, judge, **options)

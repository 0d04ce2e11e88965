"""Margin machines on dense vectors, of all classes and folds in the same passes over the rows.

A machine is a class against the others, on all rows or on those outside a fold. Rows lie in
blocks; a pass multiplies a block by the planes of all machines that still walk, so that the
number of passes is that of the longest walk, not the sum of all. The loss is the hinge with
a quadratic penalty, on features of unit deviation, and the steps are those of ``LinearSVC``;
the machines are the same up to rounding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteforge.operators.solver import signed_steps, together

BLOCK_BYTES = 1 << 20
MOST_SUMS = 64  # of tasks that the driver adds up itself
Block = tuple[np.ndarray, np.ndarray, np.ndarray]  # labels, folds and matrix of some rows


@dataclass(frozen=True)
class Machine:
    """``target`` against the other classes, on the rows outside ``fold``, or on all; the sides' weights."""

    target: int
    fold: int | None
    own: float = 1.0
    other: float = 1.0


def blocks_of(rows: DataFrame, width: int) -> RDD[Block]:
    """Rows ``(label, fold, array)`` as blocks of about a megabyte, within their parts.

    Not a frame: each of many passes would plan all that the rows are made from anew, and the driver would keep the plans.
    """
    most = max(1, BLOCK_BYTES // (8 * width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), most):
                part = batch.slice(at, most)
                x = part.column(2).flatten().to_numpy(zero_copy_only=False)
                if part.column(0).null_count or part.column(2).null_count or len(x) != len(part) * width or not np.isfinite(x).all():
                    raise ValueError("labels and vectors must hold finite numbers of the same width, no nulls")
                block = [part.column(0).to_numpy(), part.column(1).to_numpy(), x]
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()]) for v in block], ["y", "fold", "x"])

    blocks = rows.mapInArrow(run, "y binary, fold binary, x binary").rdd
    return blocks.map(lambda b: (np.frombuffer(b[0]), np.frombuffer(b[1], np.int32), np.frombuffer(b[2]).reshape(-1, width)))


def group_moments(rows: DataFrame, width: int) -> list[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """``(label, fold, rows, means, sums of squares about them)`` of rows ``(label, fold, array)``, by label and fold."""
    label, fold, x = (F.col(c) for c in rows.columns)
    summary = Summarizer.metrics("count", "mean", "variance").summary(array_to_vector(x))
    found = rows.groupBy(label.alias("y"), fold.alias("fold")).agg(summary.alias("s")).select("y", "fold", "s.*").collect()
    if any(r["y"] is None for r in found):
        raise ValueError("rows without a label")
    out = [(int(r["y"]), int(r["fold"]), r["count"], r["mean"].toArray(), r["variance"].toArray() * (r["count"] - 1)) for r in found]
    return sorted(out, key=lambda g: g[:2])


@dataclass(frozen=True)
class Scale:
    """Weighted means and deviations of a machine's rows; a feature that stands still counts for nothing."""

    total: float
    mean: np.ndarray  # in deviations
    inverse: np.ndarray
    penalty: np.ndarray

    @classmethod
    def of(cls, machine: Machine, groups: list, width: int, reg: float) -> Scale:
        total = squares = 0.0
        mean, spread = np.zeros(width), np.zeros(width)
        for y, fold, n, m, s in groups:
            if fold != machine.fold:
                w = machine.own if y == machine.target else machine.other
                total, squares, apart = total + w * n, squares + w * w * n, m - mean
                spread += w * s + apart * apart * ((total - w * n) * w * n / total)
                mean = mean + apart * (w * n / total)
        if not total:
            raise ValueError("a fold leaves no rows to fit on")
        free = total - squares / total
        deviation = np.sqrt(np.maximum(spread, 0.0) / free) if free > 0 else np.zeros(width)
        inverse = np.divide(1.0, deviation, out=np.zeros(width), where=deviation != 0)
        return cls(total, mean * inverse, inverse, reg * inverse * inverse)

    def plane(self, p: np.ndarray) -> np.ndarray:
        """Weights and intercept, for rows as they are, of the parameters of a walk."""
        return np.append(p[:-1] * self.inverse, p[-1] - p[:-1] @ self.mean)

    def loss(self, p: np.ndarray, sums: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean loss and slope, from a pass's sums: of losses, of multipliers, of rows times multipliers."""
        slope = np.append(sums[2:] * self.inverse - sums[1] * self.mean, sums[1]) / self.total
        slope[:-1] += self.penalty * p[:-1]
        return float(sums[0] / self.total + 0.5 * (self.penalty * p[:-1]) @ p[:-1]), slope


def hinge_sums(blocks: RDD[Block], machines: list[Machine], planes: np.ndarray) -> np.ndarray:
    """For every machine: its hinge losses, multipliers and rows times multipliers, summed over its rows; one pass."""
    width, shape = planes.shape[1] - 1, (len(machines), planes.shape[1] + 1)
    target, fold = np.array([m.target for m in machines]), np.array([-1 if m.fold is None else m.fold for m in machines])
    own, other = np.array([m.own for m in machines]), np.array([m.other for m in machines])

    def run(part: Iterator[Block]) -> Iterator[np.ndarray]:
        total = np.zeros(shape)
        for y, f, x in part:
            mine = y[:, None] == target
            sign = np.where(mine, 1.0, -1.0)
            weight = np.where(mine, own, other) * (f[:, None] != fold)
            loss = (1.0 - sign * (x @ planes[:, :width].T + planes[:, width])) * weight
            pull = np.where(loss > 0, -sign * weight, 0.0)
            total[:, 0] += np.maximum(loss, 0.0).sum(axis=0)
            total[:, 1] += pull.sum(axis=0)
            total[:, 2:] += pull.T @ x
        yield total

    sums = blocks.mapPartitions(run)
    if blocks.getNumPartitions() > MOST_SUMS:
        return sums.treeReduce(np.add)
    return np.sum(sums.collect(), axis=0)


def fit_machines(rows: DataFrame, blocks: RDD[Block], machines: list[Machine], width: int, reg: float, steps: int, tolerance: float) -> list[np.ndarray]:
    """Weights and intercept of every machine; ``rows`` are ``(label, fold, array)``, ``blocks`` the same rows in blocks."""
    groups = group_moments(rows, width)
    scales = [Scale.of(m, groups, width, reg) for m in machines]

    def losses(ids: list[int], asked: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
        planes = np.stack([scales[i].plane(p) for i, p in zip(ids, asked)])
        sums = hinge_sums(blocks, [machines[i] for i in ids], planes)
        return [scales[i].loss(p, s) for i, p, s in zip(ids, asked, sums)]

    ends = together([signed_steps(np.zeros(width + 1), steps, tolerance) for _ in machines], losses)
    return [s.plane(p) for s, p in zip(scales, ends)]


def plane_margins(planes: np.ndarray) -> Callable[[Column], Column]:
    """Margins of an array column against every plane (weights and intercept)."""

    @F.pandas_udf("array<double>")
    def of(rows: pd.Series) -> pd.Series:
        if not len(rows):
            return pd.Series([], dtype=object)
        return pd.Series(list(np.vstack(rows.to_numpy()) @ planes[:, :-1].T + planes[:, -1]))

    return of


def unseen_margins(blocks: RDD[Block], planes: np.ndarray) -> RDD[tuple[float, list[float]]]:
    """Label and margins of every row, with the planes (fold, target, place) that were fitted without its fold."""
    width = planes.shape[2] - 1

    def run(block: Block) -> Iterator[tuple[float, list[float]]]:
        y, fold, x = block
        m = np.zeros((len(y), planes.shape[1]))
        for f in np.unique(fold):
            at = fold == f
            m[at] = x[at] @ planes[f, :, :width].T + planes[f, :, width]
        return zip(y.tolist(), m.tolist())

    return blocks.flatMap(run)

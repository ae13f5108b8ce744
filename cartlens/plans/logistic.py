"""Ridge logistic regressions of all folds and penalties, fitted side by side.

A Newton step needs the loss, the gradient and the Hessian of every fit. One scan
gives them all: each task adds up its rows' shares for every fit in which they are
training rows, Spark sums the tasks, and the driver solves a small system per fit.
The number of scans is that of the slowest fit's steps, however many fits there are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: numbers that the Hessians of all fits may have together in a task
CELLS = 1 << 24
#: a fit ends when no entry of its gradient is larger
TOLERANCE, STEPS = 1e-11, 60
ROWS = 4096


@dataclass(frozen=True)
class Fit:
    """Rows of ``fold`` are left out (None: all rows are used)."""
    fold: int | None
    penalty: float


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def _shares(train: DataFrame, fits: list[Fit], beta: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per fit: rows, loss, gradient and Hessian at its column of ``beta`` (the last
    entry is the intercept), summed over its training rows."""
    size = len(beta)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(fits), size + 1, size + 1))
        for batch in batches:
            for part in (batch.slice(at, ROWS) for at in range(0, batch.num_rows, ROWS)):
                x = np.column_stack((_matrix(part.column(0)), np.ones(part.num_rows)))
                y, fold = part.column(1).to_numpy().astype(float), part.column(2).to_numpy()
                for j, fit in enumerate(fits):
                    used = fold != fit.fold if fit.fold is not None else slice(None)
                    a, t = x[used], y[used]
                    m = a @ beta[:, j]
                    p = 1 / (1 + np.exp(-m))
                    total[j, 0, 0] += len(t)
                    total[j, 0, 1] += (np.logaddexp(0, m) - t * m).sum()
                    total[j, 1:, 0] += a.T @ (p - t)
                    total[j, 1:, 1:] += a.T @ (a * (p * (1 - p))[:, None])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(fits), dtype=np.int32), size + 1)),
             pa.array(np.tile(np.arange(size + 1, dtype=np.int32), len(fits))),
             pa.array(total.reshape(-1, size + 1).tolist())], ["fit", "i", "y"])

    sums = F.array(*[F.sum(F.col("y")[k]) for k in range(size + 1)]).alias("y")
    found = train.mapInArrow(run, "fit int, i int, y array<double>").groupBy("fit", "i").agg(sums)
    total = np.zeros((len(fits), size + 1, size + 1))
    for r in found.collect():  # fits x (size + 1) rows
        total[r.fit, r.i] = r.y
    return total[:, 0, 0], total[:, 0, 1], total[:, 1:, 0], total[:, 1:, 1:]


def fits_together(size: int, fits: int) -> bool:
    """Whether the Hessians of so many fits of so many features are small enough."""
    return fits * (size + 2) ** 2 <= CELLS


def fit_all(train: DataFrame, fits: list[Fit], features: str = "features",
            label: str = "label", fold: str = "fold") -> np.ndarray:
    """(features + 1, fits): the coefficients of every fit, the intercept last.

    Each minimises the mean logistic loss of its training rows plus half its penalty
    times the squared coefficients, the intercept left free. A step that does not
    lower the loss is halved. A fit without rows, or with rows of one class only, has
    no minimum: its coefficients are 0.
    """
    rows = train.select(vector_to_array(features).alias("x"), F.col(label).cast("int").alias("y"),
                        F.coalesce(F.col(fold), F.lit(-1)).cast("int").alias("f"))
    first = rows.select(F.size("x").alias("n")).head()
    if first is None:
        return np.zeros((1, len(fits)))
    size = first.n
    penalty = np.array([f.penalty for f in fits])
    ridge = np.diag(np.r_[np.ones(size), 0.0])
    beta, step = np.zeros((size + 1, len(fits))), np.zeros((size + 1, len(fits)))
    best, at = np.full(len(fits), np.inf), np.zeros((size + 1, len(fits)))
    open_ = np.arange(len(fits))
    for _ in range(STEPS):
        n, loss, slope, bend = _shares(rows, [fits[j] for j in open_], beta[:, open_])
        left = []
        for i, j in enumerate(open_):
            if not n[i] or abs(slope[i, -1]) == n[i] / 2 and not beta[:, j].any():
                beta[:, j] = 0.0
                continue
            value = loss[i] / n[i] + penalty[j] / 2 * (beta[:-1, j] ** 2).sum()
            if value > best[j] + 1e-13 * abs(best[j]):
                step[:, j] /= 2
                beta[:, j] = at[:, j] + step[:, j]
                left.append(j)
                continue
            slope_j = slope[i] / n[i] + penalty[j] * ridge @ beta[:, j]
            best[j], at[:, j] = min(value, best[j]), beta[:, j]
            if np.abs(slope_j).max() <= TOLERANCE:
                continue
            step[:, j] = -np.linalg.lstsq(bend[i] / n[i] + penalty[j] * ridge, slope_j,
                                          rcond=None)[0]
            beta[:, j] = at[:, j] + step[:, j]
            left.append(j)
        open_ = np.array(left, int)
        if not len(open_):
            break
    return beta


def margins(df: DataFrame, beta: np.ndarray, fits: list[Fit], features: str = "features",
            fold: str = "fold") -> DataFrame:
    """(all columns, fit, margin): each row under the fits that left out its fold."""
    x = vector_to_array(features)
    scored = [F.when(F.col(fold) == f.fold, F.struct(
        F.lit(j).alias("fit"), (F.aggregate(F.zip_with(
            x, F.array(*[F.lit(float(b)) for b in beta[:-1, j]]), lambda a, b: a * b),
            F.lit(0.0), lambda s, v: s + v) + float(beta[-1, j])).alias("margin")))
        for j, f in enumerate(fits)]
    return (df.withColumn("_m", F.explode(F.filter(F.array(*scored), lambda m: m.isNotNull())))
            .select(*df.columns, "_m.fit", "_m.margin"))

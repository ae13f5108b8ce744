"""Embedding whitening: leading covariance eigenvectors by Jacobi-Davidson.

The covariance is never formed. Spark multiplies it with a few columns at a time:
each task centres its rows and sums ``C^T (C U)``. The driver keeps a small subspace:
Rayleigh-Ritz on it gives the wanted pairs, the correction equation of each is solved
by a few MINRES steps in the space orthogonal to all wanted vectors (one pass over
the rows serves a step of all of them), the corrections extend the subspace, and a
pair is locked when its residual is that of rounding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from decimal import Context

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .topk import matrix, valid

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: largest integer entry, and MINRES steps in a round
MOST, STEPS = 1 << 52, 3
#: the subspace is cut back beyond this many columns a wanted component
SPACE = 8
#: rows that are centred at a time
ROWS = 1 << 14
EPS = float(np.finfo(np.float64).eps)


def integers(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, x): floor(SCALE * entry) + SHIFT of every valid vector of the size that
    most have (ties: the larger)."""
    fine = vectors.where(valid(vector)).select(F.col(id_col).alias("id"),
                                               F.col(vector).alias("vector"))
    top = (fine.groupBy(F.size("vector").alias("size")).count()
           .orderBy(F.desc("count"), F.desc("size")).head())
    if top is not None:
        fine = fine.where(F.size("vector") == top["size"])
    entry = lambda e: F.greatest(F.least(
        F.floor(SCALE * e.cast("double")), F.lit(MOST)), F.lit(-MOST)) + SHIFT
    return fine.select("id", F.transform("vector", entry).alias("x"))


def whole(column: pa.Array) -> np.ndarray:
    """The rows of an Arrow column of longs, all of one size, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], width: int,
          kind: str = "double") -> list[list]:
    """The sum over all rows of ``part`` (integer rows -> matrix of ``width`` columns),
    added up in tasks first, then per matrix row by Spark."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                new = part(whole(batch.column(0).slice(at, ROWS)))
                total = new if total is None else total + new
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()), pa.array(total.tolist())], ["i", "y"])

    item = "long" if kind == "decimal(38,0)" else "double"
    found = (rows.select("x").mapInArrow(run, f"i int, y array<{item}>").groupBy("i")
             .agg(F.array(*[F.sum(F.col("y")[j].cast(kind)) for j in range(width)]).alias("y"))
             .collect())
    return [r.y for r in sorted(found, key=lambda r: r.i)]


class Covariance:
    """Centred products over stored integer rows. ``total``: their exact sums."""

    def __init__(self, rows: DataFrame, n: int, total: list[int]):
        self.rows, self.n, self.total = rows, n, total

    def centred(self) -> Callable[[np.ndarray], np.ndarray]:
        n, total = self.n, self.total

        def centre(x: np.ndarray) -> np.ndarray:
            return deviations(x, n, total).astype(np.float64) / n

        return centre

    def sums(self, part: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
        """The sum of ``part`` of the centred rows."""
        centre = self.centred()
        return np.array(_sums(self.rows, lambda x: part(centre(x)), width))

    def times(self, u: np.ndarray) -> np.ndarray:
        return self.sums(lambda c: c.T @ (c @ u), u.shape[1]) / self.n


def deviations(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n * x - total, exact: as longs if all fit, else as Python integers."""
    top = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    if n * top + max(map(abs, total), default=0) < 1 << 62:
        return n * x - np.array(total, np.int64)
    return n * x.astype(object) - np.array(total, object)


def squares(y: np.ndarray) -> list[int]:
    """The sum of the squares of each row, exact."""
    top = int(np.abs(y).max(initial=0))
    if y.shape[1] * top * top < 1 << 63:
        return (y * y).sum(1).tolist()
    return [sum(v * v for v in row) for row in y.tolist()]


def _orthonormal(new: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """The directions of ``new`` that ``bases`` do not span."""
    out = new[:, :0]
    for column in new.T:
        size = np.linalg.norm(column)
        v = column / size if size > 0 else column
        for _ in range(3):
            for base in (*bases, out):
                v = v - base @ (base.T @ v)
            left = np.linalg.norm(v)
            if left < 1e-10:
                break
            v = v / left
        else:
            out = np.column_stack((out, v))
    return out


def _minres(apply: Callable[[np.ndarray], np.ndarray], rhs: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions of one symmetric system per column, by ``steps`` MINRES
    steps; ``apply`` multiplies all columns at once, each with its own matrix."""
    def over(a, b):
        return np.divide(a, b, out=np.zeros_like(a), where=b > 0)

    gamma = np.linalg.norm(rhs, axis=0)
    eta, v, before = gamma.copy(), over(rhs, np.broadcast_to(gamma, rhs.shape)), 0.0 * rhs
    w, w_before, out = 0.0 * rhs, 0.0 * rhs, 0.0 * rhs
    s, s_before, c, c_before = 0.0 * gamma, 0.0 * gamma, 1 + 0.0 * gamma, 1 + 0.0 * gamma
    for _ in range(steps):
        image = apply(v)
        delta = (v * image).sum(0)
        image = image - delta * v - gamma * before
        after = np.linalg.norm(image, axis=0)
        a0 = c * delta - c_before * s * gamma
        a1 = np.hypot(a0, after)
        a2, a3 = s * delta + c_before * c * gamma, s_before * gamma
        w, w_before = over(v - a3 * w_before - a2 * w, np.broadcast_to(a1, v.shape)), w
        c_before, s_before = c, s
        c, s = over(a0, a1), over(after, a1)
        out = out + c * eta * w
        eta = -s * eta
        before, v = v, over(image, np.broadcast_to(after, image.shape))
        gamma = after
    return out


def eigenpairs(times: Callable[[np.ndarray], np.ndarray], size: int, want: int,
               steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """The ``want`` largest eigenvalues of a symmetric positive matrix of ``size``
    rows, falling, and their unit eigenvectors as columns. ``times`` multiplies the
    matrix with columns. Ends when every residual is within rounding of the largest
    eigenvalue, or no longer falls."""
    want = min(want, size)
    space = _orthonormal(np.random.default_rng(7).standard_normal((size, want)))
    image, locked = times(space), space[:, :0]
    top, stuck, least = 0.0, 0, np.inf
    while True:
        small = space.T @ image
        value, turn = np.linalg.eigh((small + small.T) / 2)
        value, turn = value[::-1], turn[:, ::-1]
        space, image = space @ turn, image @ turn  # Ritz vectors, largest first
        top = max(top, float(value[0]))
        need = want - locked.shape[1]
        u, theta = space[:, :need], value[:need]
        residual = image[:, :need] - u * theta
        residual -= locked @ (locked.T @ residual)
        error = np.linalg.norm(residual, axis=0)
        full = space.shape[1] + locked.shape[1] == size
        stuck = 0 if error.max() < least / 2 else stuck + 1
        least = min(least, error.max())
        fine = error <= 2 * EPS * np.sqrt(size) * top
        if full or (stuck > 3 and least <= 1e-13 * top) or stuck > 12:
            fine[:] = True
        done = need if fine.all() else int(fine.argmin())
        locked = np.column_stack((locked, space[:, :done]))
        space, image = space[:, done:], image[:, done:]
        if done == need:
            break
        u, theta, residual = u[:, done:], theta[done:], residual[:, done:]
        if done:
            stuck, least = 0, np.inf
        held = np.column_stack((locked, u))

        def project(t: np.ndarray, held=held) -> np.ndarray:
            return t - held @ (held.T @ t)

        new = _minres(lambda t, p=project, th=theta: p(times(p(t)) - th * p(t)),
                      -project(residual), steps)
        if space.shape[1] + new.shape[1] > SPACE * want:
            space = _orthonormal(space[:, :2 * want], locked)
            image = times(space)  # anew, or rounding would add up from one restart to the next
        new = _orthonormal(np.column_stack((new, residual)), locked, space)
        if not new.shape[1]:  # no residual leads further
            new = _orthonormal(np.random.default_rng(space.shape[1]).standard_normal(
                (size, 1)), locked, space)
        new = new[:, :max(1, size - locked.shape[1] - space.shape[1])]
        space, image = np.column_stack((space, new)), np.column_stack((image, times(new)))
    # the pairs of the locked space, all at once
    locked = _orthonormal(locked)
    small = locked.T @ times(locked)
    value, turn = np.linalg.eigh((small + small.T) / 2)
    return value[::-1], locked @ turn[:, ::-1]


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) per row and
    component.

    Every entry c counts as x = floor(1024 * c) + 100000. All valid vectors are
    fitted and returned, repeated rows and null ids included; null and empty vectors
    and those with null or non-finite entries are left out, and so are vectors of
    another number of dimensions than most. Entries beyond 2^52 count as 2^52.
    ``deviation`` (decimal): the sum of (n * x - S)^2, exact. Components are those
    with an eigenvalue above rounding, at most ``components``: a table that is empty,
    or whose vectors are all equal, gives no rows. Equal eigenvalues: any orthonormal
    pair of their space. Other columns are not read.

    The driver holds sums per dimension and ``SPACE`` columns a component; each
    product is one pass over the stored rows.
    """
    schema = (f"{id_col} {dict(vectors.dtypes)[id_col]}, component int, n long, "
              "deviation decimal(38,0), whitened double, explained double, identity_error double")
    spark = vectors.sparkSession
    rows = stored(integers(vectors, id_col, vector), "integers")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], schema)
    size = rows.select(F.size("x")).head()[0]
    total = [int(r[0]) for r in _sums(
        rows, lambda x: x.sum(0)[:, None], 1, "decimal(38,0)")]
    cov = Covariance(rows, n, total)
    trace = float(cov.sums(lambda c: (c * c).sum(0)[:, None], 1).sum()) / n
    if trace == 0:
        return spark.createDataFrame([], schema)
    value, vector_of = eigenpairs(cov.times, size, components)
    kept = value > size * EPS * trace
    value, basis = value[kept], vector_of[:, kept] / np.sqrt(value[kept])
    k = len(value)
    mean = cov.sums(lambda c: (c @ basis).sum(0)[None], k)[0] / n

    def outer(c: np.ndarray) -> np.ndarray:
        w = c @ basis - mean
        return w.T @ w

    error = float(np.abs(cov.sums(outer, k) / n - np.eye(k)).max())
    share, centre = (value / trace).tolist(), cov.centred()
    exact = Context(prec=60)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = whole(part.column(1))
                far = [exact.create_decimal(v) for v in squares(deviations(x, n, total))]
                m = len(far)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, np.int64)),
                    pa.array([d for d in far for _ in range(k)], pa.decimal128(38, 0)),
                    pa.array((centre(x) @ basis).ravel()),
                    pa.array(share * m), pa.array(np.full(m * k, error))],
                    [id_col, "component", "n", "deviation", "whitened", "explained",
                     "identity_error"])

    return rows.mapInArrow(run, schema)

"""Exact top-k inner products by columnar branch and bound.

The vectors lie in blocks, dimension by dimension. A query adds up its products one
block of dimensions after another; what the dimensions still to come can add is at
most the product of the two remaining lengths, so the candidates whose bound falls
below the k-th best score so far go, and only the columns that are left are read on.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import folder, partitions, share, stored

EVERY, SCALE, BEST = 50, 256, 5
#: dimensions that are added at a time
DIMS = 16
#: numbers in a candidate block, and in a block of queries (sent to every executor)
CELLS, QUERY_CELLS = 1 << 18, 1 << 21
#: queries whose first products are held at a time
ROWS = 128
#: integers up to which doubles are exact
_EXACT = float(1 << 53)
_PACKED = "size int, n int, ids binary, x binary"


def valid(vector: str):
    """Whether a vector is there and has no null or non-finite component."""
    fine = F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e)
                    & (F.abs(e.cast("double")) < float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of an Arrow list column, all of one size, as a matrix of doubles."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def packed(rows: DataFrame, scale: int, cells: int) -> DataFrame:
    """(size, n, ids, x): the scaled integer vectors of ``rows`` (id, size, vector) in
    blocks of one size, ``x`` dimension by dimension. Rows of a partition that follow
    each other and are of one size share a block."""
    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, count = [], None, 0

        def block():
            ids, x = (np.concatenate(c) for c in zip(*held, strict=True))
            return pa.RecordBatch.from_pydict({
                "size": pa.array([size], pa.int32()), "n": pa.array([len(ids)], pa.int32()),
                "ids": [ids.tobytes()], "x": [np.ascontiguousarray(x.T).tobytes()]})

        for batch in batches:
            sizes = batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.diff(sizes)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(sizes)], strict=True):
                while lo < hi:
                    most = max(1, cells // int(sizes[lo]))
                    if held and (sizes[lo] != size or count == most):
                        yield block()
                        held, count = [], 0
                    size, end = int(sizes[lo]), int(min(hi, lo + most - count))
                    part = batch.slice(lo, end - lo)
                    held.append((part.column(0).to_numpy().astype(np.int64),
                                 np.floor(scale * matrix(part.column(2)))))
                    count, lo = count + end - int(lo), end
        if held:
            yield block()

    return rows.mapInArrow(pack, _PACKED)


def unpacked(size: int, n: int, ids: bytes, x: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64, n), np.frombuffer(x, np.float64, n * size).reshape(size, n)


def _rest(x: np.ndarray) -> np.ndarray:
    """(steps + 1, n): the length of each column from each block of dimensions on."""
    with np.errstate(over="ignore"):  # endless mass prunes nothing
        mass = np.add.reduceat(x * x, np.arange(0, len(x), DIMS), axis=0)
    left = np.cumsum(mass[::-1], axis=0)[::-1]
    return np.sqrt(np.concatenate((left, np.zeros((1, x.shape[1])))))


class Search:
    """The best candidates so far of each query of a block (ids, dimension by
    dimension as ``unpacked`` gives them)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.q = np.ascontiguousarray(x.T)
        self.rest, self.most = _rest(x), float(np.abs(x).max(initial=0))
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]  # (-score, id), sorted

    def _take(self, i: int, scores, ids) -> None:
        keep = sorted(zip([-int(s) for s in scores], ids.tolist(), strict=True))[:self.k]
        self.best[i] = sorted(self.best[i] + keep)[:self.k]

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Compare all queries with the candidates of a block."""
        if len(x) * self.most * float(np.abs(x).max(initial=0)) >= _EXACT:
            # beyond exact doubles: whole integers, without bounds
            whole = np.array([[int(v) for v in row] for row in x], object)
            for i, q in enumerate(self.q):
                own = ids == self.ids[i]
                score = (np.array([int(v) for v in q], object) @ whole)[~own]
                self._take(i, np.clip(score, -(1 << 63), (1 << 63) - 1), ids[~own])
            return
        rest = _rest(x)
        for lo in range(0, len(self.q), ROWS):
            q = self.q[lo:lo + ROWS]
            first = q[:, :DIMS] @ x[:DIMS]
            for i, score in enumerate(first, lo):
                low = -self.best[i][-1][0] if len(self.best[i]) == self.k else -np.inf
                alive = np.flatnonzero((score + self._slack(1, i) * rest[1] >= low)
                                       & (ids != self.ids[i]))
                score = score[alive]
                for step, at in enumerate(range(DIMS, len(x), DIMS), 1):
                    if not len(alive):
                        break
                    part = x[at:at + DIMS]
                    part = part if len(alive) == x.shape[1] else part[:, alive]
                    score = score + self.q[i, at:at + DIMS] @ part
                    if low > -np.inf:
                        kept = score + self._slack(step + 1, i) * rest[step + 1, alive] >= low
                        if not kept.all():
                            alive, score = alive[kept], score[kept]
                if len(alive) > 8 * self.k:  # no candidate below the k-th of these can stay
                    cut = np.partition(score, len(score) - self.k)[len(score) - self.k]
                    alive, score = alive[score >= cut], score[score >= cut]
                if len(alive):
                    self._take(i, score, ids[alive])

    def _slack(self, step: int, i: int) -> float:
        return float(self.rest[step, i]) * (1 + 1e-9)  # rounding of the lengths

    def rows(self) -> Iterator[tuple[int, int, int]]:
        for query, best in zip(self.ids.tolist(), self.best, strict=True):
            for less, vec in best:
                yield query, vec, -less


def top_k(vectors: DataFrame, *, id_col: str = "vec_id", vector: str = "embedding",
          every: int = EVERY, scale: int = SCALE, k: int = BEST) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows for every query.

    Each component c becomes floor(scale * c). Queries are the rows whose id is
    divisible by ``every``; candidates all rows with another id. Score: the integer
    inner product; ties go to the smaller id. Vectors that are null, empty or hold
    null or non-finite components take no part, nor do rows without an id; vectors
    are compared with those of their own number of dimensions. Every repeated row of
    an id is a candidate; a repeated query is answered once, and queries of one id with
    different vectors share one answer. A score
    beyond a long counts as the nearest long. Other columns are not read. An empty table, or one without queries, gives no rows.

    Queries go out in blocks of ``QUERY_CELLS`` numbers; each block is one pass over
    the packed candidates, which keeps ``k`` rows a query in every task.
    """
    spark = vectors.sparkSession
    fine = vectors.where(valid(vector) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.size(vector).alias("size"),
        F.col(vector).alias("vector"))
    # long vectors first: their scores raise the limits that prune the others
    length = F.aggregate("vector", F.lit(0.0), lambda s, e: s + e.cast("double") * e)
    total = fine.agg(F.sum(F.col("size").cast("long"))).head()[0] or 0
    parts = max(partitions(spark), total // (64 * CELLS))
    order = ("size", "long", "id")  # the id, as any number of vectors may be equally long
    blocks = stored(packed(fine.withColumn("long", -length).repartitionByRange(parts, *order)
                           .sortWithinPartitions(*order).select("id", "size", "vector"),
                           scale, CELLS), "vectors")
    asked = stored(fine.where(F.col("id") % every == 0).dropDuplicates(["id", "vector"]), "asked")
    cells = asked.agg(F.sum(F.col("size").cast("long"))).head()[0] or 0
    # full blocks, however many partitions the session shuffles into
    asked = asked.coalesce(max(1, -(-cells // QUERY_CELLS))).sortWithinPartitions("size", "id")
    path = folder(spark, "best")
    schema = "query_id long, vec_id long, score long"
    spark.createDataFrame([], schema).write.parquet(path)
    for r in stored(packed(asked, scale, QUERY_CELLS), "queries").toLocalIterator():
        sent = share(spark, (r["size"], r.n, bytes(r.ids), bytes(r.x)))

        def scan(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            size, n, ids, x = sent()
            search = Search(*unpacked(size, n, ids, x), k)
            for batch in batches:
                for block in batch.to_pylist():
                    search.add(*unpacked(**block))
            found = list(zip(*search.rows(), strict=True)) or [(), (), ()]
            for at in range(0, len(found[0]), 10_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[at:at + 10_000], pa.int64()) for c in found],
                    ["query_id", "vec_id", "score"])

        found = blocks.where(F.col("size") == r["size"]).mapInArrow(scan, schema)
        _ranked(found, k).select("query_id", "vec_id", "score").write.mode("append").parquet(path)
    best = spark.read.schema(schema).parquet(path)
    return _ranked(best, k).select("query_id", "rank", "vec_id", "score")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

"""Packing documents into token sequences along a space-filling curve.

Each document's token ids are hashed into a vector, projected to a few
dimensions and turned into a Hilbert key; documents are range-sorted by that
key and laid end to end, so neighbours on the curve share a sequence. The curve
is cut every ``length`` tokens, so no sequence but the last has padding.

Only keys and token counts are sorted; the ids move once, to meet their places.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import partitions, stored

LENGTH = 2048
END = 1
#: dimensions and bits of the curve (their product stays below 64)
DIMS, BITS = 4, 15
HASHED = 256


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Keys along the Hilbert curve for unsigned integer points (n, dims)."""
    x = points.T.astype(np.int64).copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):  # turn and mirror every sub-cube back
        low = (1 << level) - 1
        for i in range(dims):
            upper = (x[i] >> level) & 1 == 1
            swap = np.where(upper, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(upper, low, swap)
            x[i] ^= swap
    for i in range(1, dims):  # Gray code over the dimensions
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> level) & 1
    return key


class Curve:
    """Hilbert keys of bags of token ids."""

    def __init__(self, dims: int = DIMS, bits: int = BITS, seed: int = 1):
        self.bits = bits
        self.directions = np.random.default_rng(seed).standard_normal((HASHED, dims))

    def key(self, bags: list[np.ndarray]) -> np.ndarray:
        vectors = np.empty((len(bags), HASHED))
        for row, ids in zip(vectors, bags, strict=True):
            h = ids.astype(np.uint32) * np.uint32(2654435761)
            row[:] = np.bincount(h >> np.uint32(24), minlength=HASHED)
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True).clip(1e-12)
        # most of every vector is what all texts have in common: look around it
        flat = (vectors - 1 / np.sqrt(HASHED)) @ self.directions
        cells = ((flat / 2 + 0.5).clip(0, 1) * ((1 << self.bits) - 1)).astype(np.int64)
        return hilbert(cells, self.bits)


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text: str = "text",
         length: int = LENGTH, end: int = END, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset and, if ``with_ids``, ids (little-endian 32-bit).

    Null and empty texts are the end token alone; null ids and repeated rows are
    documents like any other; equal keys are ordered by id, then by row. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    encoder = tokens.WordEncoder(tokens.read(tokenizer))
    kind, started = encoder.kind, tokens.on_workers(spark, encoder)
    curve = Curve()

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = started()
        for batch in batches:
            for part in tokens.by_size(batch, 2):
                ids, ends = e.encode(part.column(2), end)
                bags = np.split(ids, ends[1:-1])
                width = ids.itemsize
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(curve.key(bags), pa.int64()),
                     pa.array(np.diff(ends).astype(np.int64)), pa.Array.from_buffers(
                        pa.binary(), len(bags), [None, pa.py_buffer(ends * np.int32(width)),
                                                 pa.py_buffer(ids)])],
                    ["row", "doc_id", "key", "doc_tokens", "ids"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"),
                       F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    out = rows.select("row", "doc_id", F.lit(0).cast("long").alias("key"),
                      F.lit(0).cast("long").alias("doc_tokens"),
                      F.lit(b"").alias("ids")).schema
    coded = stored(rows.mapInArrow(encode, out), "coded")
    order = ["key", "doc_id", "row"]
    curve_order = stored(
        coded.select(*order, "doc_tokens").repartitionByRange(partitions(spark), *order)
        .withColumn("pid", F.spark_partition_id()), "curve")
    # tokens of earlier partitions: one row per partition
    sums = curve_order.groupBy("pid").agg(F.sum("doc_tokens").alias("n"))
    earlier = sums.select("pid", F.coalesce(F.sum("n").over(
        Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        .alias("before"))
    inside = (Window.partitionBy("pid").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    places = (curve_order.withColumn("upto", F.sum("doc_tokens").over(inside))
              .join(F.broadcast(earlier), "pid")  # as many rows as there are partitions
              .select("row", (F.col("before") + F.col("upto") - F.col("doc_tokens"))
                      .alias("place")))

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x.slice(at, 256) for x in batches for at in range(0, x.num_rows, 256)):
            found: list[list] = [[] for _ in names[1:]]
            source = []
            for i, (place, ids) in enumerate(zip(batch.column(1).to_pylist(),
                                                 batch.column(2).to_pylist(), strict=True)):
                own = np.frombuffer(ids, kind)
                at = 0
                while at < len(own):
                    sequence, offset = divmod(place + at, length)
                    n = min(length - offset, len(own) - at)
                    raw = own[at:at + n].astype("<u4").tobytes()
                    source.append(i)
                    for column, value in zip(found, (at, n, zlib.crc32(raw), len(own), sequence,
                                                     offset, raw if with_ids else None),
                                             strict=True):
                        column.append(value)
                    at += n
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(source, pa.int64()))]
                + [pa.array(c, pa.int64()) for c in found[:-1]]
                + [pa.array(found[-1], pa.binary())], names)

    met = coded.select("row", "doc_id", "ids").join(places, "row").select("doc_id", "place", "ids")
    schema = met.select("doc_id", *[F.lit(0).cast("long").alias(c) for c in names[1:-1]],
                        F.lit(None).cast("binary").alias("ids")).schema
    pieces = met.mapInArrow(cut, schema)
    return pieces if with_ids else pieces.drop("ids")


def sequences(pieces: DataFrame, length: int = LENGTH, pad: int = 0) -> DataFrame:
    """sequence_id and its ids (little-endian 32-bit), padded to ``length``.

    A group holds at most ``length`` tokens whatever the input."""
    blank = F.lit(np.full(length, pad, "<u4").tobytes())
    listed = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(listed, F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return (pieces.groupBy("sequence_id").agg(joined.alias("ids"))
            .withColumn("ids", F.substring(F.concat("ids", blank), 1, 4 * length)))

"""Training-order token shards.

Token ids of all documents, each followed by an end token, form one stream that
is cut every ``length`` ids. A keyed Feistel permutation of the sequence numbers
(cycle-walking keeps it inside their count) gives every sequence its slot in
training order. Slots are range-partitioned into shards; each shard is one file
of fixed-stride records in slot order, so a reader that stops at a slot goes on
from a known byte. Files go through Spark's own writer and commit protocol: a
lost executor's half-written shard never appears.

A record is ``length`` little-endian unsigned ids and one line feed.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import folder, partitions, stored

LENGTH = 1024
RECORDS = 2048
END = 50_256
KEY = 20_240_607
_ROUNDS = 6


class Order:
    """A keyed permutation of 0 .. count-1 and its inverse, for integer arrays."""

    def __init__(self, count: int, key: int = KEY):
        self.count = count
        self.half = max(1, ((max(count, 2) - 1).bit_length() + 1) // 2)
        self.keys = np.random.default_rng(key).integers(0, 2**63, _ROUNDS).astype(np.uint64)

    def _mix(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(32))) & np.uint64((1 << self.half) - 1)

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        half, low = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> half, x & low
        for key in self.keys[::-1] if back else self.keys:
            if back:
                left, right = right ^ self._mix(left, key), left
            else:
                left, right = right, left ^ self._mix(right, key)
        return left << half | right

    def _walk(self, values, back: bool) -> np.ndarray:
        x = self._once(np.asarray(values, np.uint64), back)
        while (out := x >= self.count).any():
            x[out] = self._once(x[out], back)
        return x.astype(np.int64)

    def slot(self, sequence) -> np.ndarray:
        return self._walk(sequence, False)

    def sequence(self, slot) -> np.ndarray:
        return self._walk(slot, True)


def materialise(docs: DataFrame, ranks: str, pattern: str, *, text: str = "text",
                length: int = LENGTH, records: int = RECORDS, end: int = END, key: int = KEY,
                path: str | None = None) -> str:
    """Write ``docs`` in training order; the folder's path.

    ``<path>/shards/shard=K/`` has one file with slots K * records and on;
    ``<path>/layout`` has the counts a reader needs. Null and empty texts give
    their end token alone, repeated rows repeat, and the last sequence is padded
    with the end token. An empty table gives a layout of no sequences.
    """
    spark = docs.sparkSession
    path = path or folder(spark, "token-shards")
    encoder = tokens.RankEncoder(tokens.read(ranks), pattern)
    kind, started = encoder.kind, tokens.on_workers(spark, encoder)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, pid, place = started(), TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids = e.encode(batch.slice(at, 256).column(0).to_pylist(), end)
                counts = np.array([len(x) for x in ids]) // np.dtype(kind).itemsize
                places = place + np.cumsum(counts) - counts
                place += int(counts.sum())
                yield pa.RecordBatch.from_pydict({"pid": pa.array([pid] * len(ids), pa.int32()),
                                                  "place": places, "n": counts, "ids": ids})

    coded = stored(docs.select(text).mapInArrow(
        encode, "pid int, place long, n long, ids binary"), "coded", level=9, page=8 << 20)
    sums = coded.groupBy("pid").agg(F.sum("n").alias("n"))
    earlier = stored(sums.select("pid", "n", F.coalesce(F.sum("n").over(
        Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        .alias("before")), "earlier")  # one row per input partition
    total = earlier.agg(F.sum("n")).head()[0] or 0
    count = -(-total // length)
    order = Order(count, key) if count else None

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3).compress  # ids are dense: denser in the shuffle
        for batch in (x.slice(at, 256) for x in batches for at in range(0, x.num_rows, 256)):
            sequence, offset, piece = [], [], []
            for place, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                  strict=True):
                ids, at = np.frombuffer(raw, kind), 0
                while at < len(ids):
                    s, o = divmod(place + at, length)
                    sequence.append(s)
                    offset.append(o)
                    piece.append(press(ids[at:at + length - o].tobytes()))
                    at += length - o
            yield pa.RecordBatch.from_pydict({  # at: place in training order
                "at": order.slot(sequence) * length + np.array(offset, np.int64),
                "piece": pa.array(piece, pa.binary())})

    def assemble(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, parts = None, []
        width = length * np.dtype(kind).itemsize
        pad = np.full(length, end, kind).tobytes()
        unpress = zstandard.ZstdDecompressor().decompress
        schema = pa.schema([("record", pa.binary()), ("shard", pa.int64()), ("slot", pa.int64())])

        def records_of(done):
            return pa.RecordBatch.from_pydict({
                "record": [x for _, x in done], "shard": [s // records for s, _ in done],
                "slot": [s for s, _ in done]}, schema)

        for batch in batches:
            done: list[tuple[int, bytes]] = []
            for s, piece in zip((batch.column(0).to_numpy() // length).tolist(),
                                batch.column(1).to_pylist(), strict=True):
                if s != slot:
                    if slot is not None:
                        done.append((slot, (b"".join(parts) + pad)[:width]))
                    slot, parts = s, []
                parts.append(unpress(piece))
            yield records_of(done)
        if slot is not None:
            yield records_of([(slot, (b"".join(parts) + pad)[:width])])

    if count:
        shards = -(-count // records)
        parts = min(shards, partitions(spark) * 4)
        pieces = (coded.join(F.broadcast(earlier), "pid")
                  .select((F.col("before") + F.col("place")).alias("place"), "ids")
                  .mapInArrow(cut, "at long, piece binary"))
        # ranges of slots: whole shards, as many to each partition
        to = F.expr(f"int(at div {length * records} * {parts} div {shards})")
        (pieces.repartitionById(parts, to).sortWithinPartitions("at")
         .mapInArrow(assemble, "record binary, shard long, slot long")
         .sortWithinPartitions("shard", "slot")  # as stated, for the writer keeps a stated order
         .select(F.col("record").cast("string"), "shard")
         .write.partitionBy("shard").option("compression", "none").text(f"{path}/shards"))
    layout = {"sequences": count, "tokens": total, "length": length, "records": records,
              "key": key, "kind": kind}
    spark.createDataFrame([(json.dumps(layout),)], "value string").coalesce(1).write.text(
        f"{path}/layout")
    return path


def layout_of(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/layout").head()[0])


def read_slots(spark: SparkSession, path: str, first: int = 0, last: int | None = None,
               ) -> DataFrame:
    """slot, sequence_id, shard, byte_offset, n_tokens and ids (binary) of the
    slots from ``first`` to before ``last``; only their shards are opened."""
    x = layout_of(spark, path)
    schema = "slot long, sequence_id long, shard long, byte_offset long, n_tokens long, ids binary"
    last = x["sequences"] if last is None else min(last, x["sequences"])
    if first >= last:
        return spark.createDataFrame([], schema)
    stride = x["length"] * np.dtype(x["kind"]).itemsize + 1
    files = (spark.read.format("binaryFile").load(f"{path}/shards")
             .where(F.col("shard").between(first // x["records"], (last - 1) // x["records"]))
             .select(F.col("shard").cast("long").alias("shard"), "content",
                     F.explode(F.expr(f"sequence(0L, length div {stride} - 1)")).alias("n")))
    rows = files.select((F.col("shard") * x["records"] + F.col("n")).alias("slot"), "shard",
                        (F.col("n") * stride).alias("byte_offset"),
                        F.expr(f"substring(content, int(n * {stride} + 1), {stride - 1})")
                        .alias("ids")).where(F.col("slot").between(first, last - 1))
    order, length, total = Order(x["sequences"], x["key"]), x["length"], x["tokens"]

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence = order.sequence(b.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sequence), b.column(1), b.column(2),
                 pa.array(np.minimum(length, total - sequence * length)), b.column(3)],
                ["slot", "sequence_id", "shard", "byte_offset", "n_tokens", "ids"])

    return rows.mapInArrow(number, schema)

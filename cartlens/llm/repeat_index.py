"""Removal of long repeated byte strings with run-length indexes.

Every ``width``-byte window of every text belongs to one anchor: the ``seed``
bytes in it with the smallest hash. Equal windows have equal anchors at equal
places, so whatever repeats meets under its anchor's hash, and texts whose
anchors are unique are settled by one count.

Neighbouring windows with the same anchor form a stretch. A stretch that occurs
again as a whole (the inside of a copy) is repeated, whatever its length. The
others, at the edges of copies, go with one example of each repeated stretch of
their anchor to a run-length index (``run_index``); its matching statistics mark
the windows that occur again. Anchors with many edges are split before that by
longer common cores, down to single windows, so no task gets more than a bounded
text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, release, stored, text_bytes, with_column, with_row
from .run_index import RunLengthIndex

WIDTH = 200
SEED = 64
#: bytes of text that one index is meant to hold
INDEX_BYTES = 1 << 17
#: stretches of one anchor that may share an index
EDGES = 2_000
_CHUNK = 1 << 18
_PLACE = np.uint64((1 << 20) - 1)
_BASE = 0x9E3779B97F4A7C15


class Windows:
    """Anchors of all windows of byte texts."""

    def __init__(self, width: int = WIDTH, seed: int = SEED):
        self.width, self.seed = width, seed
        n = _CHUNK + width + 1
        with np.errstate(over="ignore"):
            self.power, self.inverse = (
                np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, b, np.uint64))))
                for b in (np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))))

    @staticmethod
    def _mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        return x ^ (x >> np.uint64(33))

    def _lowest(self, x: np.ndarray, w: int) -> np.ndarray:
        """The minimum of every w neighbours."""
        n = len(x)
        blocks = np.full(-(-n // w) * w, np.uint64(2**64 - 1))
        blocks[:n] = x
        blocks = blocks.reshape(-1, w)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        return np.minimum(behind[:n - w + 1], ahead[w - 1:n])

    def stretches(self, texts: list[bytes | None]) -> tuple[np.ndarray, ...]:
        """Arrays: text number, first and last window start, anchor place (all in
        the text), anchor hash and hash of the stretch's bytes."""
        found, held, size = [], [], 0
        for i, t in enumerate(texts):
            if t is None or len(t) < self.width:
                continue
            for at in range(0, len(t) - self.width + 1, _CHUNK):
                piece = t[at:at + _CHUNK + self.width - 1]
                if size + len(piece) > _CHUNK + self.width:
                    found.append(self._chunk(held))
                    held, size = [], 0
                held.append((i, at, piece))
                size += len(piece)
        if held:
            found.append(self._chunk(held))
        if not found:
            return tuple(np.empty(0, np.int64) for _ in range(6))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _chunk(self, held: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
        k, w = self.seed, self.width - self.seed + 1
        x = np.frombuffer(b"".join(p for _, _, p in held), np.uint8).astype(np.uint64)
        n = len(x)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((x + np.uint64(1)) * self.power[:n], out=sums[1:])
        h = self._mix((sums[k:] - sums[:-k]) * self.inverse[:n - k + 1])
        place = self._lowest(h & ~_PLACE | np.arange(len(h), dtype=np.uint64), w) & _PLACE
        sizes = np.array([len(p) for _, _, p in held])
        ends = np.cumsum(sizes)
        start = np.concatenate([np.arange(e - s, e - self.width + 1)
                                for e, s in zip(ends, sizes, strict=True)])
        anchor = place[start].astype(np.int64)
        new = np.flatnonzero((anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)) + 1
        a, b = np.concatenate(([0], new)), np.concatenate((new - 1, [len(start) - 1]))
        first, last, anchor = start[a], start[b], anchor[a]
        whole = (sums[last + self.width] - sums[first]) * self.inverse[first]
        shape = ((last - first) * 1024 + anchor - first).astype(np.uint64)
        body = self._mix(self._mix(whole) + shape * np.uint64(_BASE))
        owner = np.searchsorted(ends, first, "right")
        shift = np.array([at for _, at, _ in held]) - (ends - sizes)
        return (np.array([i for i, _, _ in held])[owner], first + shift[owner],
                last + shift[owner], anchor + shift[owner], h[anchor].view(np.int64),
                body.view(np.int64))


def stretches(docs: DataFrame, row: str, text: str, width: int, seed: int) -> DataFrame:
    """(h, body, row, first, last, anchor) of all stretches."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(width, seed)
        for batch in (x.slice(at, 1024) for x in batches for at in range(0, x.num_rows, 1024)):
            i, first, last, anchor, h, body = windows.stretches(text_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h, pa.int64()), pa.array(body, pa.int64()),
                 batch.column(0).take(pa.array(i, pa.int64())), pa.array(first, pa.int32()),
                 pa.array(last, pa.int32()), pa.array(anchor, pa.int32())],
                ["h", "body", "row", "first", "last", "anchor"])

    return docs.select(F.col(row).alias("row"), F.col(text).alias("text")).mapInArrow(
        run, "h long, body long, row long, first int, last int, anchor int")


def _split(edges: DataFrame, width: int, seed: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Edges grouped by ``node`` in groups of at most ``most`` rows, and windows
    (row, first, last) already known to be repeated.

    A node is a range of window starts, counted from the anchor, with the bytes
    common to all windows of the range. A node with too many rows becomes its
    two halves, whose cores are longer; a single window's core is the window.
    """
    low, high = F.col("low"), F.col("high")
    here = (edges.withColumn("low", F.lit(seed - width)).withColumn("high", F.lit(0))
            .withColumn("node", F.col("h")))
    ready, settled = [], []
    while True:
        sizes = stored(here.groupBy("node").count().where(F.col("count") > most), "large-nodes")
        if not sizes.head(1):
            break
        ready.append(here.join(sizes, "node", "left_anti"))
        large = here.join(sizes.select("node"), "node")
        middle = F.floor((low + high) / 2).cast("int")
        halves = large.select("*", F.explode(F.array(
            F.struct(low.alias("l"), middle.alias("r")),
            F.struct((middle + 1).alias("l"), high.alias("r")))).alias("half"))
        halves = (halves.withColumn("low", F.col("half.l")).withColumn("high", F.col("half.r"))
                  .withColumn("a", F.greatest("first", F.col("anchor") + low))
                  .withColumn("b", F.least("last", F.col("anchor") + high)).where("a <= b"))
        bytes_of = lambda start, end: F.call_function(
            "substring", F.col("body"), (start - F.col("first") + 1).cast("int"),
            (end - start).cast("int"))
        halves = halves.withColumn("core", bytes_of(F.col("anchor") + high,
                                                    F.col("anchor") + low + width))
        halves = halves.withColumn("body", bytes_of(F.col("a"), F.col("b") + width)).select(
            "h", "row", F.col("a").alias("first"), F.col("b").alias("last"), "anchor", "edge",
            "body", "low", "high", "core", F.xxhash64("h", "low", "high", "core").alias("node"))
        halves = stored(halves, "halves")
        single = halves.where("low = high")  # the core is the whole window
        again = single.groupBy("core").count().where("count > 1")
        settled.append(single.where("edge").join(again, "core", "left_semi")
                       .select("row", "first", "last"))
        here = halves.where("low < high").drop("core")
    none = edges.select("row", "first", "last").limit(0)
    for part in settled:
        none = none.union(part)
    for part in ready:
        here = here.unionByName(part)
    return here, none


def repeated(docs: DataFrame, row: str, *, text: str = "text", width: int = WIDTH,
             seed: int = SEED, edges: int = EDGES, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """(row, first, last): runs of starts of ``width``-byte strings that start
    anywhere else too. ``row`` is a unique long."""
    spark = docs.sparkSession
    every = stretches(docs, row, text, width, seed)
    anchors = every.groupBy("h").count().where("count > 1").select("h")
    met = stored(every.join(anchors, "h"), "stretches")
    release(spark)
    kinds = stored(met.groupBy("h", "body").agg(
        F.count(F.lit(1)).alias("n"), F.min("row").alias("example")), "kinds")
    inside = met.join(kinds.where("n > 1").select("h", "body"), ["h", "body"], "left_semi").select(
        "row", "first", "last")
    # anchors with a stretch that occurs once: it and an example of each of the others
    open_ = kinds.where("n = 1").select("h").distinct()
    asked = (kinds.join(open_, "h", "left_semi")
             .select("h", "body", (F.col("n") == 1).alias("edge"), "example"))
    asked = (met.join(asked, ["h", "body"]).where("row = example")
             .dropDuplicates(["h", "body"])  # a row may hold its example more than once
             .groupBy("row").agg(F.collect_list(F.struct("h", "first", "last", "anchor", "edge"))
                                 .alias("asked")))
    pieces = docs.select(F.col(row).alias("row"), F.col(text).alias("text")).join(asked, "row")

    def fetch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x.slice(at, 512) for x in batches for at in range(0, x.num_rows, 512)):
            lists = batch.column(2)
            flat = lists.flatten()
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            raw = text_bytes(batch.column(1))
            body = [raw[i][a:b + width] for i, a, b in zip(
                owner.tolist(), flat.field("first").to_pylist(), flat.field("last").to_pylist(),
                strict=True)]
            yield pa.RecordBatch.from_arrays(
                [flat.field("h"), batch.column(0).take(pa.array(owner)), flat.field("first"),
                 flat.field("last"), flat.field("anchor"), flat.field("edge"),
                 pa.array(body, pa.binary())],
                ["h", "row", "first", "last", "anchor", "edge", "body"])

    cut = stored(pieces.mapInArrow(
        fetch, "h long, row long, first int, last int, anchor int, edge boolean, body binary"),
        "edges")
    release(spark)
    grouped, settled = _split(cut, width, seed, edges)
    size = cut.agg(F.sum(F.octet_length("body"))).head()[0] or 0
    tasks = max(1, -(-size // index_bytes))

    def match(t: pa.Table) -> pa.Table:
        body = t.column("body").to_pylist()
        index = RunLengthIndex(np.frombuffer(b"\xff".join(body) + b"\xff", np.uint8))
        again = index.matching_statistics() >= width
        sizes = np.array([len(b) for b in body])
        base = np.cumsum(sizes + 1) - sizes - 1
        row, first = t.column("row").to_numpy(), t.column("first").to_numpy()
        out: list[list[int]] = [[], [], []]
        for i in np.flatnonzero(t.column("edge").to_numpy()):
            hit = again[base[i]:base[i] + sizes[i] - width + 1].astype(np.int8)
            step = np.flatnonzero(np.diff(hit, prepend=0, append=0))
            for a, b in zip(step[::2], step[1::2], strict=True):
                out[0].append(row[i])
                out[1].append(first[i] + a)
                out[2].append(first[i] + b - 1)
        return pa.table({"row": pa.array(out[0], pa.int64()), "first": pa.array(out[1], pa.int32()),
                         "last": pa.array(out[2], pa.int32())})

    at_edges = (grouped.withColumn("task", F.pmod("node", F.lit(tasks)))
                .select("task", "row", "first", "edge", "body").groupBy("task")
                .applyInArrow(match, "row long, first int, last int"))
    return inside.union(settled).union(at_edges)


def _cover(raw: bytes, runs: list[tuple[int, int]], width: int) -> tuple[list, bytes]:
    """Merged removed byte ranges and the bytes that stay."""
    spans: list[list[int]] = []
    for first, last in sorted(runs):
        if spans and first <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], last + width)
        else:
            spans.append([first, last + width])
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at:a])
        at = b
    return spans, b"".join([*kept, raw[at:]])


def remove(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", width: int = WIDTH,
           seed: int = SEED, edges: int = EDGES, index_bytes: int = INDEX_BYTES,
           ) -> tuple[DataFrame, str]:
    """All rows and columns of ``docs`` plus a struct column; also its name.

    The struct has ``n_bytes`` of the UTF-8 text, ``spans`` (removed byte ranges,
    maximal, end exclusive), ``n_removed`` and ``kept`` (the bytes that stay).
    Null and short texts lose nothing (null counts as empty); matches never cross
    rows; repeated rows of ``width`` bytes or more lose all their bytes, the first
    one too. An empty table stays empty.
    """
    columns = docs.columns
    docs, row = with_row(docs, id_col)
    runs = repeated(docs, row, text=text, width=width, seed=seed, edges=edges,
                    index_bytes=index_bytes)
    by_row = stored(runs.groupBy(F.col("row").alias(row)).agg(
        F.collect_list(F.struct("first", "last")).alias("runs")), "runs")
    release(docs.sparkSession)
    listed, name = fresh("runs", docs), fresh("repeats", docs)
    met = docs.join(by_row.withColumnRenamed("runs", listed), row, "left").select(*columns, listed)
    where = columns.index(text)
    kind = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                      ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                      ("kept", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x.slice(at, 512) for x in batches for at in range(0, x.num_rows, 512)):
            found = []
            for raw, pairs in zip(text_bytes(batch.column(where)), batch.column(-1).to_pylist(),
                                  strict=True):
                raw = raw or b""
                spans, kept = _cover(raw, [(p["first"], p["last"]) for p in pairs or ()], width)
                found.append({"n_bytes": len(raw), "n_removed": len(raw) - len(kept),
                              "spans": [{"start": a, "end": b} for a, b in spans], "kept": kept})
            yield with_column(batch.drop_columns([listed]), name, pa.array(found, kind))

    schema = met.drop(listed).withColumn(name, F.lit(None).cast(
        "struct<n_bytes:bigint,n_removed:bigint,spans:array<struct<start:bigint,end:bigint>>,"
        "kept:binary>")).schema
    return met.mapInArrow(run, schema), name

"""Sharding by longest-processing-time scheduling of groups of equal texts.

Groups are too many to schedule one by one on the driver. Every group larger
than 1/UNITS of all bytes is a unit of its own (there can be fewer than UNITS
of those); all other groups are bundled by hash into UNITS bundles, so a group
always stays whole. Units, largest first, go to the least-loaded shard through
a heap. At most 2 x UNITS units reach the driver at any input size.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dense_rank_offsets, stored

UNITS = 16_384


def longest_first(units: Iterable[tuple[int, int]], shards: int) -> dict[int, int]:
    """unit key -> shard for (key, size) pairs: the largest unit next, always to
    the least-loaded shard; equal sizes by key, equal loads by shard number."""
    heap = [(0, s) for s in range(shards)]
    placed = {}
    for key, size in sorted(units, key=lambda u: (-u[1], u[0])):
        load, shard = heap[0]
        placed[key] = shard
        heapq.heapreplace(heap, (load + size, shard))
    return placed


def assign(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", shards: int = 16,
           units: int = UNITS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot for every row of ``docs``.

    ``size`` is the text's UTF-8 bytes plus 1 (null: no bytes, so 1, and CRC 0 as
    for the empty text). Rows of equal text share a shard; ``slot`` counts each
    shard's rows from 0 without gaps. Null ids and repeated rows are rows like
    any other. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = stored(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        # equal texts have equal keys; should two texts meet in one key, their
        # groups merely stay together
        F.xxhash64(body).alias("group"), F.spark_partition_id().alias("pid")), "rows")
    total = rows.agg(F.sum("size")).head()[0] or 0
    sizes = rows.groupBy("group").agg(F.sum("size").alias("bytes"))
    large = {r["group"]: r["bytes"]  # fewer than ``units`` rows
             for r in sizes.where(F.col("bytes") > total / units).collect()}
    bundle = F.pmod(F.col("group"), F.lit(units))
    small = (sizes.where(F.col("bytes") <= total / units)
             .groupBy(bundle.alias("bundle")).agg(F.sum("bytes").alias("bytes")).collect())
    placed = longest_first([(("g", k), v) for k, v in large.items()]
                           + [(("b", r["bundle"]), r["bytes"]) for r in small], shards)
    singles = spark.createDataFrame([(k, s) for (kind, k), s in placed.items() if kind == "g"],
                                    "`group` long, own int")
    bundles = spark.createDataFrame([(k, s) for (kind, k), s in placed.items() if kind == "b"],
                                    "bundle long, common int")
    at = (rows.join(F.broadcast(singles), "group", "left")  # both at most ``units`` rows
          .join(F.broadcast(bundles), bundle == F.col("bundle"), "left")
          .withColumn("shard", F.coalesce("own", "common"))
          .select("doc_id", "size", "text_crc32", "shard", "pid"))
    # slot: rows of earlier input partitions, then the rank inside this one; an
    # input partition has a bounded number of rows whatever keys they hold
    within = Window.partitionBy("shard", "pid").orderBy("doc_id", "text_crc32", "size")
    return (at.withColumn("nth", F.row_number().over(within))
            .join(dense_rank_offsets(at, ["shard"]), ["shard", "pid"])
            .select("doc_id", "size", "text_crc32", "shard",
                    (F.col("before") + F.col("nth") - 1).cast("long").alias("slot")))

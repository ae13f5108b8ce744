"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint has a bit set where more than half of the XXH64 hashes of
its word shingles have it. Fingerprints are cut into segments, few enough that
two fingerprints within ``max_bits`` have a segment within one bit (pigeonhole).
Every distinct fingerprint is filed under each segment's value; the Hamming
ball of radius one around each segment value is enumerated and looked up, and
matches are verified on all 64 bits. Copies share a fingerprint and take part
once, so a group of copies costs one row however large it is.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, stored, text_bytes, with_column
from .components import components

SHINGLE = 3
MAX_BITS = 3
SEED = 42
_CHUNK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit integer; 0 without words."""
    w = text.lower().split() if text else []  # bytes: A-Z and ASCII white space only
    if not w:
        return 0
    line = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w])
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(w) - shingle + 1)
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        a = starts[at:min(at + _CHUNK, n)].tolist()
        b = ends[min(shingle, len(w)) - 1:][at:at + len(a)].tolist()
        h = np.array([digest(line[i:j - 1], SEED) for i, j in zip(a, b, strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1,
                              bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", shingle: int = SHINGLE,
                     ) -> tuple[DataFrame, str]:
    """All rows and columns of ``docs`` plus the fingerprint (long); its name."""
    name = fresh("fingerprint", docs)
    where = docs.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t, shingle) for t in text_bytes(batch.column(where))]
            yield with_column(batch, name, pa.array(values, pa.int64()))

    return docs.mapInArrow(run, docs.withColumn(name, F.lit(0).cast("long")).schema), name


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b) with a < b: distinct fingerprints in column ``fp`` of ``prints``
    that differ in at most ``max_bits`` bits, each pair once."""
    parts = max(1, -(-(max_bits + 1) // 2))
    cuts = [64 * i // parts for i in range(parts + 1)]
    fp = F.col("fp")

    def segment(c, lo: int, hi: int):
        return F.shiftrightunsigned(F.shiftleft(c, 64 - hi), 64 - hi + lo)

    def rows(each):
        return prints.select("fp", F.posexplode(F.array(*each)).alias("part", "value"))

    index = rows([segment(fp, lo, hi) for lo, hi in zip(cuts, cuts[1:], strict=False)])
    # two values one bit apart differ in parity: only the even one looks around
    balls = []
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        own = segment(fp, lo, hi)
        near = F.array(own, *[own.bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)))
                              for i in range(hi - lo)])
        balls.append(F.when(F.bit_count(own) % 2 == 0, near).otherwise(F.array(own)))
    probe = (rows(balls).select(fp.alias("a"), "part", F.explode("value").alias("value")))
    met = (probe.join(index.withColumnRenamed("fp", "b"), ["part", "value"])
           .where((F.col("a") != F.col("b"))
                  & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def group_of(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, linked): the smallest fingerprint reachable, for fingerprints with links."""
    found = stored(links(prints, max_bits), "fp-links")
    return components(found).select(F.col("node").alias("fp"), F.col("component").alias("linked"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text",
                    shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row.

    ``component_id`` is the smallest id reachable over links, itself included.
    Null, empty and blank texts have fingerprint zero and are linked like any
    other; null ids are never the smallest unless a group has no other; repeated
    rows get equal results; an empty table gives an empty result.
    """
    rows, fp = with_fingerprint(docs.select(F.col(id_col).alias("doc_id"),
                                            F.col(text).alias("text")), "text", shingle)
    rows = stored(rows.select("doc_id", F.col(fp).alias("fp")), "fingerprints")
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    member = (prints.join(group_of(prints.select("fp"), max_bits), "fp", "left")
              .withColumn("linked", F.coalesce("linked", "fp")))
    least = member.groupBy("linked").agg(F.min("first").alias("component_id"))
    by_print = member.join(least, "linked").select("fp", "component_id")
    return rows.join(by_print, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text",
             shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` left when one row of each group stays: the one with
    the smallest id (null last; repeated rows: the first stored)."""
    marked, fp = with_fingerprint(docs, text, shingle)
    row = fresh("row", marked)
    marked = stored(marked.withColumn(row, F.monotonically_increasing_id()), "marked")
    rows = marked.select(F.col(fp).alias("fp"), F.col(id_col).alias("id"), F.col(row).alias("r"))
    first = rows.groupBy("fp").agg(
        F.min(F.struct(F.col("id").isNull().alias("n"), "id", "r")).alias("first"))
    member = (first.join(group_of(first.select("fp"), max_bits), "fp", "left")
              .withColumn("linked", F.coalesce("linked", "fp")))
    kept = member.groupBy("linked").agg(F.min("first").alias("first")).select("first.r")
    return marked.join(kept, marked[row] == kept["r"], "left_semi").select(*docs.columns)

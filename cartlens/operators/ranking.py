"""Exact ranks inside a few large strata without one huge window partition.

A class label has two values, so ``row_number() OVER (PARTITION BY label)``
would put half of the table into one task. ``bucketed_rank`` instead:

  (a) gives each row a bucket: the first ``digits`` hex characters of its
      hash order key (16**digits buckets per stratum, evenly filled);
  (b) counts rows per (stratum, bucket) -- a small aggregate;
  (c) turns those counts into offsets with a window partitioned by stratum
      over at most 16**digits rows;
  (d) numbers rows inside each (stratum, bucket) partition;
  (e) adds the offset, joined back by (stratum, bucket).

The result equals ``row_number() OVER (PARTITION BY strata ORDER BY key)``.
The hash order key must be unique per row (ties are broken by ``tiebreak``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .joins import attach


def bucket_digits(largest_stratum: int, target_rows: int = 200_000, minimum: int = 3) -> int:
    """Hex digits so that one (stratum, bucket) partition holds about
    ``target_rows`` rows or fewer: 16**digits >= largest / target."""
    d = minimum
    while 16 ** d * target_rows < largest_stratum and d < 12:
        d += 1
    return d


def hash_order(seed: int | str, key: str | Column) -> Column:
    """Deterministic pseudo-random order key, identical in Spark and DuckDB."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string")))


def bucketed_rank(df: DataFrame, strata: Sequence[str], order: Column,
                  tiebreak: Sequence[str] = (), digits: int = 3,
                  out: str = "rank") -> DataFrame:
    """1-based rank of each row inside its stratum by the hex string ``order``."""
    strata = list(strata)
    b = df.withColumn("_ord", order).withColumn("_bkt", F.substring("_ord", 1, digits))
    counts = b.groupBy(*strata, "_bkt").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*strata).orderBy("_bkt")
    offsets = counts.select(*strata, "_bkt",
                            (F.sum("_n").over(w) - F.col("_n")).alias("_off"))
    keys = [*strata, "_bkt"]  # at most (strata values) x 16**digits rows
    ranked = attach(b, offsets, {c: F.col(c) for c in keys}, null_safe=True)
    w2 = Window.partitionBy(*strata, "_bkt").orderBy("_ord", *tiebreak)
    return (ranked.withColumn(out, F.col("_off") + F.row_number().over(w2))
            .drop("_ord", "_bkt", "_off"))

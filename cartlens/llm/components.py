"""Connected components of a link table, wholly in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links``; component: its smallest node.

    Alternates large-star and small-star rounds until the link table no longer
    changes: every node ends as a leaf of its component's smallest node. Each
    round pre-aggregates the smallest neighbour per node before it joins, and
    is written to the shared folder. Links of null or of a node to itself add
    nothing. The number of rounds grows with the logarithm of the longest chain.
    """
    x = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    x = stored(x.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
               .distinct(), "links")
    state = None
    while True:
        both = x.union(x.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours of u go to u's smallest
        x = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        x = x.distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        least = x.groupBy("u").agg(F.min("v").alias("m"))
        x = (x.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
             .union(least.select("u", F.col("m").alias("v"))).distinct())
        x = stored(x, "links")
        now = x.agg(F.count(F.lit(1)), F.sum(F.col("v").cast("decimal(20,0)")),
                    F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).head()
        if now == state:
            return x.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                x.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state = now

"""Train-fitted transforms: exact stratified split, conditional probabilities,
group-mean ratios, one-hot levels, class weights and standardisation.

Everything is fitted on the training rows only and applied to both sides;
fitted tables are aggregates (one row per group or per observed pair) that
stay frames and are joined back; the planner broadcasts them by their size.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize
from .joins import attach
from .ranking import bucket_digits, hash_order


# ---------------------------------------------------------------- D1
def test_allocation(df: DataFrame, label: str, test_size: float = 0.2) -> DataFrame:
    """(label, n, n_test) per class: ``ceil(test_size * rows)`` test rows in all;
    the train share is spread over classes by largest remainder (ties by class
    label), and each class's test count is what remains."""
    classes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    rows = classes.agg(F.sum("n")).first()[0] or 0
    n_train = rows - math.ceil(test_size * rows)
    exact = F.col("n") * F.lit(n_train) / F.lit(max(rows, 1))
    shares = classes.withColumns({"_low": F.floor(exact), "_rest": exact - F.floor(exact)})
    need = n_train - (shares.agg(F.sum("_low")).first()[0] or 0)  # below the class count
    up = (shares.orderBy(F.desc("_rest"), F.col(label).cast("string").asc_nulls_last())
          .limit(need).select(F.col(label).alias("_up"), F.lit(1).alias("_more")))
    x = shares.join(up, F.col(label).eqNullSafe(F.col("_up")), "left")
    return x.select(label, "n", (F.col("n") - F.col("_low")
                                 - F.coalesce("_more", F.lit(0))).alias("n_test"))


def stratified_split(df: DataFrame, key: str, label: str, test_size: float = 0.2,
                     seed: int = 42, digits: int | None = None) -> DataFrame:
    """Adds ``is_test``: an exact stratified split, reproducible in SQL.

    Within each class, rows are ordered by ``md5('<seed>:<key>')`` and the
    first ``n_test`` rows of the class go to test. Only counts per class and
    hash bucket are shuffled, and the rows of the one bucket per class in which
    the cut falls; every row is then compared with its class's cut, so whole
    rows never move. The result does not depend on partitioning or row order.
    """
    alloc = materialize(test_allocation(df, label, test_size))
    if digits is None:
        digits = bucket_digits(alloc.agg(F.max("n")).first()[0] or 0)
    order = hash_order(seed, key)
    keyed = df.select(F.col(label).alias("_c"), F.col(key).alias("_key"), order.alias("_h"),
                      F.substring(order, 1, digits).alias("_b"))
    counts = keyed.groupBy("_c", "_b").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("_c").orderBy("_b"))  # 16**digits rows a class
    wanted = alloc.select(F.col(label).alias("_l"), "n_test")
    cut_bucket = (counts.withColumn("_upto", upto)
                  .join(wanted, F.col("_c").eqNullSafe(F.col("_l")))
                  .where((F.col("_upto") >= F.col("n_test"))
                         & (F.col("_upto") - F.col("_n") < F.col("n_test")))
                  .select(F.col("_l"), F.col("_b").alias("_cb"),
                          (F.col("n_test") - F.col("_upto") + F.col("_n")).alias("_nth")))
    inside = keyed.join(cut_bucket, F.col("_c").eqNullSafe(F.col("_l"))
                        & (F.col("_b") == F.col("_cb")))
    nth = F.row_number().over(Window.partitionBy("_l", "_cb").orderBy("_h", "_key"))
    cuts = materialize(inside.withColumn("_rn", nth).where("_rn = _nth").select(
        "_l", F.col("_h").alias("_cut"), F.col("_key").alias("_cut_key")))
    met = df.join(cuts, F.col(label).eqNullSafe(F.col("_l")), "left")  # one row per class
    test = (order < F.col("_cut")) | ((order == F.col("_cut"))
                                      & (F.col(key) <= F.col("_cut_key")))
    return met.withColumn("is_test", F.coalesce(test, F.lit(False))).drop(
        "_l", "_cut", "_cut_key")


def split(df: DataFrame, key: str, label: str, test_size: float = 0.2, seed: int = 42
          ) -> tuple[DataFrame, DataFrame]:
    flagged = stratified_split(df, key, label, test_size, seed)
    return (flagged.where(~F.col("is_test")).drop("is_test"),
            flagged.where(F.col("is_test")).drop("is_test"))


# ---------------------------------------------------------------- D2, D3, D4
@dataclass
class ConditionalTable:
    """P(cat | group) with Laplace smoothing, over categories seen in train.

    ``counts`` holds the observed pairs ``(g, c, n)``, with group and category
    in Spark's string form whatever their type. An unobserved pair of seen
    levels gets ``s / (total + s * n_cats)`` without materialising the grid.
    ``train_mean`` is the mean of P over the train rows, from the same table.
    """
    group: str
    cat: str
    counts: DataFrame
    smoothing: float
    n_cats: int
    train_mean: float | None


def fit_conditionals(train: DataFrame, group: str, cats: Sequence[str],
                     smoothing: float = 1.0) -> dict[str, ConditionalTable]:
    """Several P(cat | group) tables from ONE scan: the (cat, group, level)
    pairs are stacked with ``explode`` and counted together. The fitted tables
    stay frames; one row per category column reaches the driver."""
    items = [F.struct(F.lit(c).alias("name"), F.col(group).cast("string").alias("g"),
                      F.col(c).cast("string").alias("c")) for c in cats]
    stacked = (train.select(F.explode(F.array(*items)).alias("t")).select("t.*")
               .where(F.col("g").isNotNull() & F.col("c").isNotNull()))
    counts = materialize(stacked.groupBy("name", "g", "c").agg(F.count(F.lit(1)).alias("n")))
    totals = counts.groupBy("name", "g").agg(F.sum("n").alias("total"))
    levels = counts.groupBy("name").agg(F.count_distinct("c").alias("k"))
    p = (F.col("n") + smoothing) / (F.col("total") + smoothing * F.col("k"))
    stats = (counts.join(totals, ["name", "g"]).join(levels, "name").groupBy("name")
             .agg(F.max("k").alias("k"), (F.sum(F.col("n") * p) / F.sum("n")).alias("mean")))
    by = {r["name"]: r for r in stats.collect()}
    return {c: ConditionalTable(group, c, counts.where(F.col("name") == c).select("g", "c", "n"),
                                smoothing, by[c]["k"] if c in by else 0,
                                by[c]["mean"] if c in by else None) for c in cats}


def fit_conditional(train: DataFrame, group: str, cat: str, smoothing: float = 1.0
                    ) -> ConditionalTable:
    return fit_conditionals(train, group, [cat], smoothing)[cat]


def conditional_table(t: ConditionalTable) -> DataFrame:
    """Fitted probabilities for the observed pairs: (group, cat, p)."""
    s = t.smoothing
    totals = t.counts.groupBy("g").agg(F.sum("n").alias("total"))
    p = (F.col("n") + s) / (F.col("total") + s * t.n_cats)
    return t.counts.join(totals, "g").select(F.col("g").alias(t.group), F.col("c").alias(t.cat),
                                             p.alias("p"))


def apply_conditional(df: DataFrame, t: ConditionalTable, out: str) -> DataFrame:
    """Look up P(cat | group) per row; NULL where group or cat is unseen."""
    s = t.smoothing
    g, c = F.col(t.group).cast("string"), F.col(t.cat).cast("string")
    x = attach(df, t.counts.groupBy("g").agg(F.sum("n").alias("_total")), {"g": g})
    x = attach(x, t.counts.select("c").distinct().withColumn("_seen", F.lit(True)), {"c": c})
    x = attach(x, t.counts.withColumnRenamed("n", "_n"), {"g": g, "c": c})
    p = F.when(F.col("_total").isNotNull() & F.col("_seen"),
               (F.coalesce(F.col("_n"), F.lit(0)) + s) / (F.col("_total") + s * t.n_cats))
    return x.withColumn(out, p).drop("_n", "_total", "_seen")


def fill_with_train_mean(train: DataFrame, test: DataFrame, col: str,
                         mean: float | None = None) -> DataFrame:
    """Fill NULLs of ``col`` in test with the mean of ``col`` over train."""
    m = mean if mean is not None else train.agg(F.avg(col)).first()[0]
    return test if m is None else test.withColumn(col, F.coalesce(F.col(col), F.lit(m)))


def fit_score(df: DataFrame, cols: Sequence[str], out: str) -> DataFrame:
    e = F.col(cols[0])
    for c in cols[1:]:
        e = e * F.col(c)
    return df.withColumn(out, e)


# ---------------------------------------------------------------- D5
@dataclass
class GroupMeans:
    """Train means of ``value`` per ``group``: ``table`` is ``(g, mean)`` with the
    group in Spark's string form; ``global_mean`` covers every train row."""
    group: str
    value: str
    table: DataFrame
    global_mean: float | None


def fit_group_means_many(train: DataFrame, specs: Sequence[tuple[str, str]]) -> list[GroupMeans]:
    """Several (group, value) mean tables from ONE scan, stacked by ``explode``.
    The NULL group counts towards the global mean, as in the analysed code."""
    items = [F.struct(F.lit(i).alias("k"), F.col(g).cast("string").alias("g"),
                      F.col(v).cast("double").alias("v")) for i, (g, v) in enumerate(specs)]
    stacked = train.select(F.explode(F.array(*items)).alias("t")).select("t.*")
    sums = materialize(stacked.groupBy("k", "g").agg(F.sum("v").alias("s"),
                                                     F.count("v").alias("c")))
    whole = sums.groupBy("k").agg(F.try_divide(F.sum("s"), F.sum("c")).alias("mean"))
    means = {r["k"]: r["mean"] for r in whole.collect()}  # one row per spec
    seen = sums.where("g is not null and c > 0")
    return [GroupMeans(g, v, seen.where(F.col("k") == i).select(
        "g", (F.col("s") / F.col("c")).alias("mean")), means.get(i))
        for i, (g, v) in enumerate(specs)]


def fit_group_means(train: DataFrame, group: str, value: str) -> GroupMeans:
    return fit_group_means_many(train, [(group, value)])[0]


def apply_group_means(df: DataFrame, gm: GroupMeans, out: str, fill_unseen: bool,
                      fill: Column | None = None) -> DataFrame:
    """``out = value / group mean``, NULL for an unseen group and a zero mean
    (where pandas gives inf). With ``fill_unseen`` the rows of unseen groups get
    ``value / global mean``; with ``fill`` too, every ratio that has no value
    (unseen group, NULL value, zero over zero) gets ``fill`` instead."""
    v = F.col(gm.value)
    x = attach(df, gm.table.withColumnRenamed("mean", "_gm"),
               {"g": F.col(gm.group).cast("string")})
    mean = F.col("_gm")
    ratio = F.try_divide(v, mean)
    if fill_unseen and fill is not None:
        missing = mean.isNull() | v.isNull() | ((mean == 0) & (v == 0))
        ratio = F.when(missing, fill).otherwise(ratio)
    elif fill_unseen:
        ratio = F.when(mean.isNull(), F.try_divide(v, F.lit(gm.global_mean).cast("double"))
                       ).otherwise(ratio)
    return x.withColumn(out, ratio).drop("_gm")


def group_mean_ratio(train: DataFrame, test: DataFrame, group: str, value: str, out: str,
                     fallback: str = "global_mean") -> tuple[DataFrame, DataFrame]:
    """``value / train mean of value in its group`` on train and test.

    Test rows whose group is unseen fall back to ``value / train global
    mean`` (``global_mean``); with any other ``fallback``, every test ratio
    without a value becomes the train mean of the ratio.
    """
    gm = fit_group_means(train, group, value)
    tr = apply_group_means(train, gm, out, fill_unseen=False)
    fill = None
    if fallback != "global_mean":
        fill = F.lit(tr.agg(F.avg(out)).first()[0]).cast("double")
    return tr, apply_group_means(test, gm, out, fill_unseen=True, fill=fill)


# ---------------------------------------------------------------- D6
def one_hot_levels(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column_name, level, slot): sorted levels per column seen in train.

    This is the slot layout of ``StringIndexer(stringOrderType='alphabetAsc')``
    followed by ``OneHotEncoder``; test values outside it get all zeros. The levels
    of all columns are sorted by ranges: a level's slot is its place in its range
    plus its column's levels in earlier ranges, so no task holds a column's levels.
    NULL is no level; a column without levels has no rows.
    """
    from .stats import label_counts
    lv = materialize(
        label_counts(train, cols).select(F.col("name").alias("column_name"),
                                         F.col("value").alias("level"))
        .repartitionByRange("column_name", "level").withColumn("_part", F.spark_partition_id()))
    sizes = lv.groupBy("column_name", "_part").agg(F.count(F.lit(1)).alias("_n"))
    # a column has a row a range at most
    earlier = (Window.partitionBy("column_name").orderBy("_part")
               .rowsBetween(Window.unboundedPreceding, -1))
    before = sizes.select("column_name", "_part",
                          F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("column_name", "_part").orderBy("level"))
    return lv.join(before, ["column_name", "_part"]).select(
        "column_name", "level", (F.col("_before") + place - 1).cast("int").alias("slot"))


# ---------------------------------------------------------------- D7
#: rows that one task may as well hold
FEW_ROWS = 10_000


def _weights(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    stats = c.agg(F.sum("n").alias("_rows"), F.count(F.lit(1)).alias("_k")).first()
    return c.withColumn("weight", F.lit(float(stats["_rows"])) / (F.lit(stats["_k"]) * F.col("n"))
                        ), stats["_rows"]


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight) with weight = n_rows / (n_classes * n_class)."""
    return _weights(df, label)[0]


def with_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """``df`` with the weight of each row's class.

    The planner cannot tell that the classes are few, so it would shuffle all rows by
    class, into as many tasks as there are classes. Beyond ``FEW_ROWS`` the weights are
    written first: their size is known then, and the rows stay where they are.
    """
    w, rows = _weights(df, label)
    w = w.select(label, F.col("weight").alias(out))
    return attach(df, materialize(w) if rows > FEW_ROWS else w, {label: F.col(label)})


# ---------------------------------------------------------------- D9
@dataclass
class Standardizer:
    """Column-wise standardisation with population std; zero std divides by 1."""
    cols: list
    means: dict
    stds: dict

    def transform(self, df: DataFrame, prefix: str = "") -> DataFrame:
        return df.withColumns({
            f"{prefix}{c}": (F.col(c) - F.lit(self.means[c])) / F.lit(self.stds[c])
            for c in self.cols})


def fit_standardizer(train: DataFrame, cols: Sequence[str]) -> Standardizer:
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    r = train.agg(*aggs).first()
    means = {c: float(r[f"m_{c}"] or 0.0) for c in cols}
    stds = {c: (float(r[f"s_{c}"]) if r[f"s_{c}"] else 1.0) for c in cols}
    return Standardizer(list(cols), means, stds)


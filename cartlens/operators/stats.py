"""Distributions, cross-tabs, association strength and group rates.

Scale notes
-----------
* Label counting is a plain ``groupBy`` with map-side partial aggregation, so
  a label holding a third of all rows costs one row per map task.
* What reaches the driver is bounded by construction: labels with a share of
  at least ``min_share`` (at most ``1/min_share`` per column), the top-n
  labels, the column names of a wide table, and scalars.
* No window holds the labels of a column: totals are aggregates joined back.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions.features import map_expr
from ..session import materialize
from .joins import attach


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]


def _domain(df: DataFrame, col: str) -> list:
    """Sorted labels, for a wide table's column names."""
    return [r[0] for r in
            df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col).collect()]


# ---------------------------------------------------------------- C1
def label_counts(df: DataFrame, cols: Sequence[str], with_nulls: bool = False) -> DataFrame:
    """Long ``(name, value, n)`` counts for several columns in one pass.

    With ``with_nulls`` the NULL label of each column is counted too, so the
    per-column sum of ``n`` is the row count and no extra job is needed for it.
    """
    items = [F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value"))
             for c in cols]
    stacked = df.select(F.explode(F.array(*items)).alias("kv")).select("kv.*")
    if not with_nulls:
        stacked = stacked.where(F.col("value").isNotNull())
    return stacked.groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))


def frequent_label_counts(df: DataFrame, cols: Sequence[str],
                          min_share: float = L.RARE_SHARE
                          ) -> tuple[dict[str, dict], dict[str, int]]:
    """Counts of the labels whose share of all rows is at least ``min_share``,
    and per column the number of non-null rows whose label is rarer.

    At most ``floor(1/min_share)`` labels per column can qualify, so what is
    collected has a proven size bound, whatever the table size. The input is
    read once; the count table is written, and every column counts all rows.
    """
    counts = materialize(label_counts(df, cols, with_nulls=True))
    known = F.col("value").isNotNull()
    totals = {r["name"]: r for r in counts.groupBy("name").agg(
        F.sum("n").alias("rows"), F.sum(F.when(known, F.col("n"))).alias("known")).collect()}
    n_rows = max((r["rows"] for r in totals.values()), default=0)
    kept: dict[str, dict] = {c: {} for c in cols}
    for r in counts.where(known & (F.col("n") / F.lit(max(n_rows, 1)) >= F.lit(min_share))
                          ).collect():
        kept[r["name"]][r["value"]] = r["n"]
    rare = {c: ((totals[c]["known"] or 0) if c in totals else 0) - sum(kept[c].values())
            for c in cols}
    return kept, rare


def frequent_labels(df: DataFrame, cols: Sequence[str],
                    min_share: float = L.RARE_SHARE) -> dict[str, list[str]]:
    """Labels whose share of all rows is at least ``min_share`` (see
    :func:`frequent_label_counts`)."""
    kept, _ = frequent_label_counts(df, cols, min_share)
    return {c: list(v) for c, v in kept.items()}


def top_after_collapse(kept: dict, rare: int, n: int, label: str = L.RARE_LABEL) -> list:
    """Top-n labels of a column after rare collapse, from its collapse counts."""
    cands = dict(kept)
    if rare:
        cands[label] = cands.get(label, 0) + rare
    return [v for v, _ in sorted(cands.items(), key=lambda kv: (-kv[1], kv[0]))[:n]]


def collapse_rare(df: DataFrame, cols: Sequence[str] | None = None,
                  min_share: float = L.RARE_SHARE, label: str = L.RARE_LABEL,
                  keep: dict[str, list] | None = None) -> DataFrame:
    """Labels with share strictly below ``min_share`` become ``label``.

    The share denominator is all rows, nulls included; nulls stay null.
    Every string column is considered when ``cols`` is None. ``keep`` applies
    frequent labels fitted earlier (new data is collapsed like training data).
    """
    if keep is not None:
        cols = [c for c in keep if c in df.columns]
    else:
        cols = list(cols) if cols is not None else string_columns(df)
    if not cols or (keep is None and min_share <= 0):
        return df
    keep = keep if keep is not None else frequent_labels(df, cols, min_share)
    return df.withColumns({
        c: F.when(F.col(c).isNull() | F.col(c).isin(keep[c]), F.col(c))
            .otherwise(F.lit(label))
        for c in cols
    })


# ---------------------------------------------------------------- C2
def value_counts(df: DataFrame, col: str) -> DataFrame:
    """``(value, n, pct)`` with pct the share of non-null rows, by count desc."""
    return (value_counts_many(df, [col]).select("value", "n", "pct")
            .orderBy(F.desc("n"), "value"))


def value_counts_many(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(column_name, value, n, pct)`` for several columns in one scan.

    The totals are a second aggregate over the same counts (the planner reuses
    their shuffle), joined back: one row per column.
    """
    counts = label_counts(df, cols)
    x = attach(counts, counts.groupBy("name").agg(F.sum("n").alias("_all")),
               {"name": F.col("name")})
    return x.select(F.col("name").alias("column_name"), "value", "n",
                    (F.col("n") * 100.0 / F.col("_all")).alias("pct"))


# ---------------------------------------------------------------- C3
def top_labels(df: DataFrame, col: str, n: int = L.TOP_LOCATIONS) -> list:
    """The n most frequent non-null labels; ties broken by label."""
    rows = (df.where(F.col(col).isNotNull()).groupBy(col)
            .agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc(col)).limit(n).collect())
    return [r[0] for r in rows]


def keep_top(df: DataFrame, col: str, out: str, n: int = L.TOP_LOCATIONS,
             other: str = "Other", top: Sequence | None = None) -> DataFrame:
    top = list(top) if top is not None else top_labels(df, col, n)
    return df.withColumn(out, F.when(F.col(col).isin(top), F.col(col)).otherwise(F.lit(other)))


# ---------------------------------------------------------------- C4, C5
def contingency(df: DataFrame, a: str, b: str, b_levels: Sequence | None = None) -> DataFrame:
    """Long ``(a, b, n)`` counts including zero cells; null rows dropped.

    The cells of a level of ``a`` are the levels of ``b``, taken from one array
    value, so the table stays long at any number of levels. ``b`` is text.
    """
    pairs = (df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
             .select(F.col(a).alias("_a"), F.col(b).cast("string").alias("_b"))
             .groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("_n")))
    if b_levels is not None:
        levels = F.array(*[F.lit(str(v)) for v in b_levels])
    else:
        levels = pairs.agg(F.array_sort(F.collect_set("_b"))).scalar()
    cells = pairs.select("_a").distinct().select(
        F.col("_a").alias(a), F.explode(levels).alias(b))
    x = attach(cells, pairs, {"_a": F.col(a), "_b": F.col(b)})
    return x.select(a, b, F.coalesce("_n", F.lit(0)).cast("long").alias("n"))


def crosstab_pct(df: DataFrame, a: str, b: str, b_levels: Sequence | None = None,
                 out_names: Sequence[str] | None = None,
                 row_labels: dict | None = None) -> DataFrame:
    """Row-percent table in wide form: one row per ``a`` level, rows sum to 100."""
    b_levels = list(b_levels) if b_levels is not None else _domain(df, b)
    out_names = list(out_names) if out_names is not None else [str(v) for v in b_levels]
    wide = (df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
            .groupBy(a).pivot(b, b_levels).agg(F.count(F.lit(1))))
    cells = [F.coalesce(F.col(f"`{v}`"), F.lit(0)) for v in b_levels]
    total = sum(cells[1:], cells[0])
    key = F.col(a)
    if row_labels:
        key = F.coalesce(map_expr(a, row_labels), F.col(a).cast("string"))
    return wide.select(key.alias(a), *[
        (c * 100.0 / total).alias(name) for c, name in zip(cells, out_names)])


# ---------------------------------------------------------------- C6, C7
def cramers_v_frame(df: DataFrame, a: str, b: str, yates: bool = True) -> DataFrame:
    """One-row frame ``(chi2, n, r, k, cramers_v)``.

    chi2 = n * (sum over observed cells of O^2/(R*C)) - n, which needs no
    zero cells. For a 2x2 table with Yates' correction every cell has the
    same |O - E|, so chi2 = (d - min(0.5, d))^2 * sum(1/E) over all 4 cells,
    where sum(1/E) = n * sum(1/R) * sum(1/C) needs only the margins.
    """
    pairs = (df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
             .groupBy(F.col(a).alias("a"), F.col(b).alias("b"))
             .agg(F.count(F.lit(1)).cast("double").alias("o")))  # doubles: products of counts
    # margins are aggregates of the pair table, whose shuffle the planner reuses
    rows = pairs.groupBy("a").agg(F.sum("o").alias("R"), F.count(F.lit(1)).alias("ra"))
    columns = pairs.groupBy("b").agg(F.sum("o").alias("C"), F.count(F.lit(1)).alias("cb"))
    cells = pairs.join(rows, "a").join(columns, "b")
    m = cells.agg(
        F.sum("o").alias("n"),
        F.count_distinct("a").alias("r"), F.count_distinct("b").alias("k"),
        F.sum(F.col("o") * F.col("o") / (F.col("R") * F.col("C"))).alias("s"),
        F.sum(1.0 / (F.col("R") * F.col("ra"))).alias("inv_r"),
        F.sum(1.0 / (F.col("C") * F.col("cb"))).alias("inv_c"),
        F.first("o").alias("o1"), F.first("R").alias("r1"), F.first("C").alias("c1"))
    n = F.col("n")
    plain = n * F.col("s") - n
    d = F.abs(F.col("o1") - F.col("r1") * F.col("c1") / n)
    corrected = F.pow(d - F.least(F.lit(0.5), d), 2) * n * F.col("inv_r") * F.col("inv_c")
    is2x2 = (F.col("r") == 2) & (F.col("k") == 2)
    chi2 = F.when(F.lit(yates) & is2x2, corrected).otherwise(plain)
    v = F.when((F.col("r") < 2) | (F.col("k") < 2), F.lit(0.0)).otherwise(
        F.sqrt(F.greatest(chi2, F.lit(0.0)) / (n * (F.least("r", "k") - 1))))
    return m.select(chi2.alias("chi2"), n.cast("long").alias("n"), F.col("r"), F.col("k"), v.alias("cramers_v"))


def cramers_v(df: DataFrame, a: str, b: str, yates: bool = True) -> float:
    row = cramers_v_frame(df, a, b, yates).first()
    return 0.0 if row is None or row["cramers_v"] is None else float(row["cramers_v"])


def drop_redundant(df: DataFrame, drop: str = "discount_applied",
                   keep: str = "promo_code_used", cutoff: float = L.REDUNDANCY_V
                   ) -> tuple[DataFrame, float | None]:
    """Drop ``drop`` when Cramer's V against ``keep`` exceeds ``cutoff``."""
    if drop not in df.columns or keep not in df.columns:
        return df, None
    v = cramers_v(df, drop, keep)
    return (df.drop(drop) if v > cutoff else df), v


# ---------------------------------------------------------------- C8, C9
def kpis(df: DataFrame) -> DataFrame:
    """Headline figures: rows, mean age, subscription %, weighted spend,
    previous purchases and rating, in one aggregate over the cleaned input."""
    return df.agg(
        F.count(F.lit(1)).alias("n_customers"),
        F.avg("age").alias("mean_age"),
        (F.avg(F.when(F.col("subscription_status") == "Yes", 1.0).otherwise(0.0)) * 100)
        .alias("subscription_pct"),
        F.avg(F.col("previous_purchases") * F.col("purchase_amount_usd"))
        .alias("mean_weighted_spend"),
        F.avg("previous_purchases").alias("mean_previous_purchases"),
        F.avg("review_rating").alias("mean_rating"))


def rate_by(df: DataFrame, group: str, cond: Column, name: str = "rate_pct") -> DataFrame:
    """Percent of rows meeting ``cond`` per group, ascending (NULL groups dropped)."""
    return (df.where(F.col(group).isNotNull()).groupBy(group)
            .agg((F.avg(F.coalesce(cond, F.lit(False)).cast("double")) * 100).alias(name))
            .orderBy(name, group))


# ---------------------------------------------------------------- C10
#: parts over which a group's distinct values are dealt to meet the grid
KDE_PARTS = 64


def kde(df: DataFrame, value: str, group: str, grid: int = 200, cut: float = 3.0) -> DataFrame:
    """Gaussian density of ``value`` per ``group`` on a ``grid``-point support.

    Scott's bandwidth ``n^(-1/5) * std(ddof=1)``; support from
    ``min - cut*bw`` to ``max + cut*bw``; each group integrates to one.
    Rows are first collapsed to distinct ``(group, value, count)``, then each
    distinct value meets the grid points within 40 bandwidths (farther terms
    underflow to exactly 0) by ``explode(sequence)``, and the sum is a partial
    aggregate: the cost is at most distinct values x grid, never pairs of rows.
    Values meet their group's row by ``(group, part)``: it is copied to ``KDE_PARTS``
    parts over which a group's values are dealt, so no task holds a group, and the join
    is a sort-merge join, as the planner would take the values for the small side.
    A grid point no value reaches has density 0 and is still reported.
    """
    base = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    stats = base.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.stddev_samp(value).alias("sd"),
        F.min(value).alias("lo"), F.max(value).alias("hi"))
    stats = (stats.withColumn("bw", F.pow(F.col("n").cast("double"), -0.2) * F.col("sd"))
             .where(F.col("bw") > 0))  # constant or single-value groups have no curve
    support = stats.select(
        group, "n", "bw",
        (F.col("lo") - cut * F.col("bw")).alias("g0"),
        ((F.col("hi") - F.col("lo") + 2 * cut * F.col("bw")) / (grid - 1)).alias("step"))
    distinct = base.groupBy(group, F.col(value).alias("x")).agg(F.count(F.lit(1)).alias("w"))
    # A kernel term beyond 40 bandwidths is exp(-800) == 0.0 in double, so each
    # value meets only the grid points within +-40 bw: the same sums, bit for bit.
    reach = F.lit(40.0) * F.col("bw")
    lo = F.greatest(F.lit(0), F.ceil((F.col("x") - reach - F.col("g0")) / F.col("step")) - 1)
    hi = F.least(F.lit(grid - 1), F.floor((F.col("x") + reach - F.col("g0")) / F.col("step")) + 1)
    parts = support.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(KDE_PARTS - 1))))
    pts = (distinct.withColumn("_part", F.pmod(F.xxhash64("x"), F.lit(KDE_PARTS)).cast("int"))
           .hint("merge").join(parts, [group, "_part"])
           .withColumn("_lo", lo.cast("int")).withColumn("_hi", hi.cast("int"))
           .where(F.col("_lo") <= F.col("_hi"))
           .select(group, "x", "w", "n", "bw", "g0", "step",
                   F.explode(F.sequence("_lo", "_hi")).alias("i")))
    # every grid point exists even where no value reaches: zero-weight rows
    full = support.select(group, F.col("g0").alias("x"), F.lit(0).cast("long").alias("w"),
                          "n", "bw", "g0", "step",
                          F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("i"))
    pts = pts.unionByName(full)
    g = F.col("g0") + F.col("i") * F.col("step")
    z = (g - F.col("x")) / F.col("bw")
    return (pts.groupBy(group, "i")
            .agg(F.first(g).alias("x"),
                 F.sum(F.col("w") * F.exp(-0.5 * z * z)).alias("k"),
                 F.first("n").alias("n"), F.first("bw").alias("bw"))
            .select(group, F.col("i").alias("point"), "x",
                    (F.col("k") / (F.col("n") * F.col("bw") * math.sqrt(2 * math.pi)))
                    .alias("density")))

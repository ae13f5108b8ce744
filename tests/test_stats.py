"""Aggregation and association operators: edge frames and properties."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartlens.operators import stats as st


def test_rare_edge_strict(spark):
    rows = [("a",)] * 1 + [("b",)] * 2 + [(None,)] * 10 + [("c",)] * 187
    df = spark.createDataFrame(rows, "x string")
    out = {r[0]: r[1] for r in st.collapse_rare(df).groupBy("x").count().collect()}
    # a: 0.5% -> Rare; b: exactly 1% stays; nulls stay null
    assert out == {"Rare": 1, "b": 2, None: 10, "c": 187}


def test_frequent_labels_bounded(spark):
    df = spark.range(1000).select((F.col("id") % 500).cast("string").alias("x"))
    assert st.frequent_labels(df, ["x"], 0.01) == {"x": []}


def test_top_tie(spark):
    rows = [(f"l{i:02d}",) for i in range(12) for _ in range(5)]
    df = spark.createDataFrame(rows, "x string")
    assert st.top_labels(df, "x", 10) == [f"l{i:02d}" for i in range(10)]
    kept = st.keep_top(df, "x", "g", 10).where(F.col("g") == "Other").count()
    assert kept == 10


def test_one_level_v_zero(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "x")], "a string, b string")
    assert st.cramers_v(df, "a", "b") == 0.0


def test_two_by_two_yates(spark):
    rows = [("n", "n")] * 10 + [("n", "y")] * 3 + [("y", "n")] * 2 + [("y", "y")] * 15
    df = spark.createDataFrame(rows, "a string, b string")
    r = st.cramers_v_frame(df, "a", "b", yates=True).first()
    assert r["chi2"] == pytest.approx(10.458, abs=1e-3)
    plain = st.cramers_v_frame(df, "a", "b", yates=False).first()
    assert plain["chi2"] == pytest.approx(13.032, abs=1e-3)
    assert r["cramers_v"] == pytest.approx(math.sqrt(r["chi2"] / 30), rel=1e-12)


def test_v_bounds_larger_table(spark):
    df = spark.range(300).select((F.col("id") % 3).alias("a"), (F.col("id") % 4).alias("b"))
    v = st.cramers_v(df, "a", "b")
    assert 0.0 <= v <= 1.0


def test_crosstab_rows_sum_100(spark):
    df = spark.range(97).select((F.col("id") % 3).cast("string").alias("a"),
                                F.when(F.col("id") % 5 == 0, "Yes").otherwise("No").alias("b"))
    for r in st.crosstab_pct(df, "a", "b", ["No", "Yes"]).collect():
        assert r["No"] + r["Yes"] == pytest.approx(100.0)


def test_contingency_zero_cells(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "a string, b string")
    got = sorted(tuple(r) for r in st.contingency(df, "a", "b").collect())
    assert got == [("a", "x", 1), ("a", "y", 0), ("b", "x", 0), ("b", "y", 1)]


def test_mode_tie_and_unknown(spark):
    from cartlens.operators.segment import profile_segments
    df = spark.createDataFrame(
        [(1, 0, "b"), (2, 0, "a"), (3, 0, "c"), (4, 1, None)],
        "customer_id long, cluster int, category string")
    for c in ["age", "purchase_amount_usd", "previous_purchases", "review_rating",
              "frequency_value_new", "spend_per_purchase_new", "total_spend_weighted_new"]:
        df = df.withColumn(c, F.lit(1.0))
    for c in ["payment_method", "shipping_type", "location", "subscription_status", "promo_code_used"]:
        df = df.withColumn(c, F.lit("x"))
    got = {r["cluster"]: r["top_category"] for r in profile_segments(df).collect()}
    assert got == {0: "a", 1: "Unknown"}


def test_kde_integrates_to_one(spark):
    df = spark.range(500).select(((F.col("id") * 7919) % 1000 / 10.0).alias("v"),
                                 F.when(F.col("id") % 3 == 0, "Yes").otherwise("No").alias("g"))
    d = st.kde(df, "v", "g").toPandas()
    for _, part in d.groupby("g"):
        part = part.sort_values("point")
        area = ((part.density.values[1:] + part.density.values[:-1]) / 2 * part.x.diff().values[1:]).sum()
        assert area == pytest.approx(1.0, abs=0.02)


def test_kde_skips_degenerate_group(spark):
    df = spark.createDataFrame([(1.0, "a"), (1.0, "a"), (2.0, "b"), (5.0, "b")], "v double, g string")
    d = st.kde(df, "v", "g").toPandas()
    assert set(d.g) == {"b"} and len(d) == 200


def test_top_after_collapse_equals_recount(spark):
    rows = [(f"s{i % 37}",) for i in range(2000)] + [(f"r{i}",) for i in range(300)] + [(None,)] * 50
    df = spark.createDataFrame(rows, "x string").repartition(5)
    kept, rare = st.frequent_label_counts(df, ["x"])
    direct = st.top_labels(st.collapse_rare(df, ["x"]), "x", 10)
    assert st.top_after_collapse(kept["x"], rare["x"], 10) == direct
    assert rare["x"] == 300


def test_cramers_v_of_huge_counts(spark):
    """Counts are doubles, so that their products leave the long range."""
    df = spark.createDataFrame([("x", "p"), ("y", "q")], "a string, b string")
    rows = spark.createDataFrame([("x", "p", 4.0e9), ("y", "q", 4.0e9)], "a string, b string, o double")
    assert rows.select(F.sum(F.col("o") * F.col("o"))).first()[0] == 3.2e19
    assert st.cramers_v(df, "a", "b", yates=False) == pytest.approx(1.0)


def test_contingency_of_many_levels_stays_long(spark):
    df = spark.range(300).select((F.col("id") % 150).cast("string").alias("a"),
                                 (F.col("id") % 100).cast("string").alias("b"))
    t = st.contingency(df, "a", "b")
    assert t.count() == 150 * 100 and t.agg(F.sum("n")).first()[0] == 300


def test_kde_values_are_dealt_over_tasks(spark, tmp_path):
    """The values of a group stay spread when they meet the grid: they are not broadcast
    (they were: their table looks smaller to the planner than the groups' own), and the
    join's key splits a group."""
    rows = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"),
        (F.pmod(F.xxhash64("id"), F.lit(99991)) / 7).alias("x"), F.lit("text").alias("other"))
    rows.write.parquet(str(tmp_path / "t"))
    out = st.kde(spark.read.parquet(str(tmp_path / "t")), "x", "g", grid=20)
    got = out.orderBy("g", "point").collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin [g" in plan
    assert "_part" in plan.split("SortMergeJoin [", 1)[1].split("]", 1)[0]
    for g in "ab":
        x = np.array([r.x for r in rows.where(F.col("g") == g).collect()])
        bw = len(x) ** -0.2 * x.std(ddof=1)
        at = np.linspace(x.min() - 3 * bw, x.max() + 3 * bw, 20)
        want = np.exp(-0.5 * ((at[:, None] - x) / bw) ** 2).sum(1) / (
            len(x) * bw * np.sqrt(2 * np.pi))
        assert np.allclose([r.density for r in got if r.g == g], want, rtol=1e-9)

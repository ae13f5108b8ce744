"""Hot keys: one customer, label or class holding a third (or more) of the rows."""

import pandas as pd
from pyspark.sql import functions as F

from cartlens.operators import stats as st
from cartlens.operators.ranking import bucketed_rank, hash_order
from cartlens.sources.shop import latest_lines


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_latest_lines_hot_customer(spark):
    # customer 1 owns a third of all orders; latest line must still be exact
    n_orders = 600
    orders = spark.range(n_orders).select(
        F.col("id").alias("o_orderkey"),
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 50 + 2).cast("long").alias("o_custkey"))
    li = spark.range(n_orders * 4).select(
        (F.col("id") % n_orders).alias("l_orderkey"),
        ((F.col("id") * 7) % 97).alias("l_partkey"), ((F.col("id") * 3) % 11).alias("l_suppkey"),
        (F.col("id") / n_orders + 1).cast("int").alias("l_linenumber"),
        ((F.col("id") * 13) % 1000 / 10.0).alias("l_extendedprice"),
        ((F.col("id") % 11) / 100.0).alias("l_discount"),
        F.lit("N").alias("l_returnflag"), F.lit("O").alias("l_linestatus"),
        F.timestamp_seconds(((F.col("id") * 7919) % 5000) * 86400).alias("l_shipdate"))
    got = latest_lines(li, orders).toPandas().set_index("o_custkey").sort_index()
    assert "Window" not in _plan(latest_lines(li, orders))
    lp, op = li.toPandas(), orders.toPandas()
    j = lp.merge(op, left_on="l_orderkey", right_on="o_orderkey")
    j = j.sort_values(["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                       "l_extendedprice"], ascending=False)
    want = j.groupby("o_custkey").first()
    counts = j.groupby("o_custkey").size()
    assert (got["n_lines"] == counts.loc[got.index]).all()
    assert (got["l_orderkey"] == want.loc[got.index, "l_orderkey"]).all()
    assert (got["l_linenumber"] == want.loc[got.index, "l_linenumber"]).all()
    assert got.loc[1, "n_lines"] == n_orders // 3 * 4


def test_rank_spreads_dominant_class(spark):
    # 90% of rows in one class: ranks are exact and no partition holds the class
    n = 20000
    df = spark.range(n).select(F.col("id").alias("k"),
                               F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("c"))
    order = hash_order(7, "k")
    r = bucketed_rank(df, ["c"], order, ["k"], digits=2, out="r")
    pdf = r.toPandas()
    for c, part in pdf.groupby("c"):
        assert sorted(part.r) == list(range(1, len(part) + 1))
    sizes = (df.select("c", F.substring(order, 1, 2).alias("b")).groupBy("c", "b").count()
             .agg(F.max("count")).first()[0])
    assert sizes < n * 0.9 / 100  # largest window partition ~ class / 256


def test_rare_collapse_with_dominant_label(spark):
    rows = [("hot",)] * 400 + [(f"l{i}",) for i in range(800)]
    df = spark.createDataFrame(rows, "x string").repartition(7)
    got = {r[0]: r[1] for r in st.collapse_rare(df).groupBy("x").count().collect()}
    assert got == {"hot": 400, "Rare": 800}
    pd.testing.assert_series_equal(
        pd.Series(st.frequent_labels(df, ["x"])["x"]), pd.Series(["hot"]))

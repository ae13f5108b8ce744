"""Edge frames for sources and column features (FIXTURES section 3)."""

import pytest
from pyspark.sql import functions as F

from cartlens.functions import features as fe
from cartlens.functions import lookups as L
from cartlens.sources import io


def test_dirty_numeric(spark):
    df = spark.createDataFrame([("12",), (" 5 ",), ("1e3",), ("x",), ("nan",), ("",), (None,)], "age string")
    got = [r[0] for r in io.coerce_numeric(df, ["age", "absent"]).collect()]
    assert got == [12.0, 5.0, 1000.0, None, None, None, None]


def test_header_odd(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`Customer ID` int, ` b ` int, `Purchase Amount (USD)` int")
    assert io.normalize_header(" b ") == "_B_"
    assert [io.normalize_header(c) for c in df.columns] == ["CUSTOMER_ID", "_B_", "PURCHASE_AMOUNT_(USD)"]
    assert io.normalize_headers(df).columns == ["customer_id", "b", "purchase_amount_usd"]


def test_read_customers_csv(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text("Customer ID,Age,Gender,Purchase Amount (USD)\n1,30,Male,12.5\n2,NA,Female,x\n")
    df = io.read_customers(spark, str(p), "csv")
    rows = df.orderBy("customer_id").collect()
    assert df.columns == ["customer_id", "age", "gender", "purchase_amount_usd"]
    assert rows[0]["age"] == 30.0 and rows[1]["age"] is None and rows[1]["purchase_amount_usd"] is None


def test_bin_edges(spark):
    vals = [0.0, 13.0, 13.5, 25.0, 30.0, 30.5, 45.0, 56.0, 200.0, 201.0, None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    age = [r[0] for r in df.select(fe.cut_expr("x", L.AGE_EDGES, L.AGE_LABELS)).collect()]
    assert age == [None, "18-30", "18-30", "18-30", "18-30", "31-45", "31-45", "46-56", "57-70", None, None]
    loy = [r[0] for r in df.select(fe.cut_expr("x", L.LOYALTY_EDGES, L.LEVEL_LABELS, True)).collect()]
    assert loy == ["Low", "Low", "Mid", "Mid", "High", "High", "Very High", "Very High", "Very High", None, None]


def test_flat_quantiles_raise(spark):
    df = spark.createDataFrame([(v,) for v in [1.0, 1.0, 1.0, 1.0, 2.0]], "x double")
    with pytest.raises(ValueError):
        fe.qcut_edges(df, "x", 4)


def test_exact_quantiles_match_numpy(spark):
    import numpy as np
    vals = [float((i * 37) % 101) for i in range(997)] + [5.0] * 300
    df = spark.createDataFrame([(v,) for v in vals], "x double").repartition(7)
    ps = [0, 0.1, 0.25, 0.5, 0.75, 0.9, 1]
    want = np.quantile(np.array(vals), ps)
    got = fe.exact_quantiles(df, "x", ps, accuracy=50)
    assert np.allclose(got, want, rtol=0, atol=1e-9)
    # tiny collect cap: brackets are narrowed in rounds, still exact
    got = fe.exact_quantiles(df, "x", ps, accuracy=20, max_collect=3)
    assert np.allclose(got, want, rtol=0, atol=1e-9)


def test_exact_quantiles_continuous_narrowing(spark):
    import numpy as np
    rng = np.random.default_rng(5)
    vals = rng.lognormal(size=20000).tolist()
    df = spark.createDataFrame([(v,) for v in vals], "x double").repartition(5)
    ps = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = fe.exact_quantiles(df, "x", ps, accuracy=100, max_collect=50)
    assert np.allclose(got, np.quantile(np.array(vals), ps), rtol=0, atol=1e-12)


def test_unknown_labels(spark):
    df = spark.createDataFrame([("Never", "Cheque", "Rare"), (None, None, None)], "f string, p string, s string")
    r = df.select(fe.map_expr("f", L.FREQUENCY_PER_YEAR).alias("f"),
                  fe.map_expr("p", L.PAYMENT_TYPE).alias("p"),
                  fe.climate_expr("s").alias("s"),
                  F.concat(fe.as_label("f"), F.lit("_"), fe.as_label("p")).alias("x")).collect()
    assert [tuple(x) for x in r] == [(None, None, "Unknown", "Never_Cheque"), (None, None, "Unknown", "nan_nan")]


def test_rating_null_flag(spark):
    df = spark.createDataFrame([(3.9,), (4.0,), (None,)], "r double")
    assert [x[0] for x in df.select(fe.flag_expr(F.col("r") >= 4)).collect()] == [0, 1, 0]


def test_fixed_values_complete():
    states = [s for _, group in L.CLIMATE_GROUPS for s in group]
    assert len(states) == 50 == len(set(states))
    assert set(L.SEGMENT_NAMES) == set(L.SEGMENT_ACTIONS) == {0, 1, 2, 3, 4}


def test_exact_quantiles_heavy_ties_need_no_narrowing(spark):
    import numpy as np
    vals = [float(i % 7) for i in range(5000)]  # 5000 rows, 7 distinct values
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = fe.exact_quantiles(df, "x", [0, 0.25, 0.5, 0.75, 1], accuracy=100, max_collect=50)
    assert np.allclose(got, np.quantile(np.array(vals), [0, 0.25, 0.5, 0.75, 1]))


def test_csv_is_read_like_a_data_frame(spark, tmp_path):
    p = tmp_path / "q.csv"
    p.write_text('Customer ID,Age,Color\n1,20,"say ""hi"", ok"\n2,12d,"two\nlines"\n'
                 '3,1e3,n/a\n4, 7 ,NULL\n5,30,red,extra\n6,.5,"a"\n')
    got = {r.customer_id: r for r in io.read_customers(spark, str(p), "csv",
                                                       bad_rows="_corrupt").collect()}
    assert got[1].color == 'say "hi", ok' and got[2].color == "two\nlines"
    assert (got[1].age, got[2].age, got[3].age, got[4].age, got[6].age) == (20, None, 1000, 7, 0.5)
    assert got[3].color is None and got[4].color is None
    assert "extra" in got[5]._corrupt
    assert [k for k, r in got.items() if r._corrupt is not None] == [5]
    with pytest.raises(Exception, match="(?i)malformed"):
        io.read_customers(spark, str(p), "csv").collect()


def test_numbers_keep_their_value(spark):
    df = spark.createDataFrame([(1, 2.5, float("nan"))], "a int, b double, c double")
    r = io.coerce_numeric(df, ["a", "b", "c", "gone"]).first()
    assert (r.a, r.b, r.c) == (1.0, 2.5, None)


def test_quantile_paths_agree(spark):
    """The whole-column bracket and the narrowed ones give the same quantiles."""
    df = spark.range(5000).select(((F.col("id") * 7919) % 5003).cast("double").alias("x"))
    probs = {"x": [0, 0.1, 0.25, 0.5, 0.9, 1]}
    want = fe.exact_quantiles_multi(df, probs)
    assert fe.exact_quantiles_multi(df, probs, accuracy=50, max_collect=20) == want
    row = df.agg(*[F.percentile("x", p).alias(f"p{i}") for i, p in enumerate(probs["x"])]).first()
    assert want["x"] == pytest.approx(list(row))

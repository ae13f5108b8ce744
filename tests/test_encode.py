"""Split, fitted encodings and their leakage guarantees."""

import pytest
from pyspark.sql import functions as F

from cartlens.operators import encode as en
from cartlens.operators.ranking import bucketed_rank, hash_order
from pyspark.sql.window import Window


def _frame(spark, n=2003):
    return spark.range(n).select(
        F.col("id").alias("customer_id"),
        F.when(F.col("id") % 3 == 0, "Yes").otherwise("No").alias("subscription_status"))


def test_bucketed_rank_equals_row_number(spark):
    df = _frame(spark)
    order = hash_order(42, "customer_id")
    a = bucketed_rank(df, ["subscription_status"], order, ["customer_id"], 2, "r")
    w = Window.partitionBy("subscription_status").orderBy(order, "customer_id")
    b = df.withColumn("r", F.row_number().over(w))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_split_exact_disjoint_complete_stable(spark):
    df = _frame(spark)
    s1 = en.stratified_split(df, "customer_id", "subscription_status")
    s2 = en.stratified_split(df.repartition(13), "customer_id", "subscription_status")
    t1 = {r[0] for r in s1.where("is_test").select("customer_id").collect()}
    t2 = {r[0] for r in s2.where("is_test").select("customer_id").collect()}
    assert t1 == t2
    assert s1.count() == 2003 and len(t1) == 401  # ceil(0.2 * 2003)
    counts = {r[0]: r[1] for r in s1.where("is_test").groupBy("subscription_status").count().collect()}
    alloc = en.test_allocation(df, "subscription_status").collect()
    assert counts == {r.subscription_status: r.n_test for r in alloc}


def test_allocation_largest_remainder(spark):
    df = spark.createDataFrame([(x,) for x in "aaaaabbbbbc"] + [(None,)] * 4, "y string")
    alloc = {r.y: r.n_test for r in en.test_allocation(df, "y", 0.2).collect()}
    assert sum(alloc.values()) == 3  # ceil(0.2 * 15)
    # train shares 4, 4, 0.8, 3.2: the largest remainder is that of c
    assert alloc == {"a": 1, "b": 1, "c": 0, None: 1}


def test_split_of_a_null_class_and_tiny_classes(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else "a" if i % 4 < 3 else f"k{i}")
                                for i in range(200)], "customer_id long, y string")
    out = en.stratified_split(df, "customer_id", "y").collect()
    assert len(out) == 200 and sum(r.is_test for r in out) == 40
    alloc = {r.y: r.n_test for r in en.test_allocation(df, "y").collect()}
    for y, n in alloc.items():
        assert sum(r.is_test for r in out if r.y == y) == n


@pytest.mark.parametrize("kind", ["boolean", "double", "string"])
def test_fitted_tables_match_keys_of_any_type(spark, kind):
    def key(i):
        return None if i % 7 == 0 else {"boolean": i % 2 == 0, "double": 1e7 * (i % 3),
                                        "string": "abc"[i % 3]}[kind]

    rows = [(key(i), float(i % 5), None if i % 11 == 0 else float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, f"g {kind}, c double, v double")
    t = en.fit_conditional(df, "g", "c")
    for r in en.apply_conditional(df, t, "p").collect():
        same = [x for x in rows if x[0] == r.g and r.g is not None]
        want = (sum(x[1] == r.c for x in same) + 1) / (len(same) + 5) if same else None
        assert r.p == (None if want is None else pytest.approx(want))
    _, out = en.group_mean_ratio(df, df, "g", "v", "r")
    every = [v for _, _, v in rows if v is not None]
    for r in out.collect():
        same = [v for g, _, v in rows if g == r.g and v is not None and g is not None]
        mean = sum(same) / len(same) if same else sum(every) / len(every)
        assert r.r == (None if r.v is None else pytest.approx(r.v / mean))


def test_other_fallback_fills_every_missing_ratio(spark):
    train = spark.createDataFrame([("a", 2.0), ("a", 4.0), ("b", 3.0)], "g string, v double")
    test = spark.createDataFrame([("a", None), ("new", 5.0), ("a", 6.0)], "g string, v double")
    _, te = en.group_mean_ratio(train, test, "g", "v", "r", fallback="mean_ratio")
    assert sorted(r.r for r in te.collect()) == [pytest.approx(1.0), pytest.approx(1.0),
                                                 pytest.approx(2.0)]


def test_conditional_probs_sum_to_one(spark):
    df = spark.range(500).select((F.col("id") % 4).cast("string").alias("g"),
                                 (F.col("id") % 7).cast("string").alias("c"))
    t = en.fit_conditional(df.where(F.col("id") % 11 != 0), "g", "c")
    full = spark.createDataFrame([(g, c) for g in "0123" for c in "0123456"], "g string, c string")
    p = en.apply_conditional(full, t, "p").groupBy("g").agg(F.sum("p").alias("s")).collect()
    for r in p:
        assert r["s"] == pytest.approx(1.0)


def test_unseen_levels_and_fill(spark):
    train = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "g string, c string")
    test = spark.createDataFrame([("a", "z"), ("q", "x"), ("b", "y")], "g string, c string")
    t = en.fit_conditional(train, "g", "c")
    out = {(r.g, r.c): r.p for r in en.apply_conditional(test, t, "p").collect()}
    assert out[("a", "z")] is None and out[("q", "x")] is None
    assert out[("b", "y")] == pytest.approx(1 / 3)  # zero cell: (0+1)/(1+2)
    filled = en.fill_with_train_mean(en.apply_conditional(train, t, "p"),
                                     en.apply_conditional(test, t, "p"), "p")
    assert all(r.p is not None for r in filled.collect())


def test_group_mean_ratio_fallbacks(spark):
    train = spark.createDataFrame([("a", 2.0), ("a", 4.0), ("z", 0.0)], "g string, v double")
    test = spark.createDataFrame([("a", 6.0), ("new", 2.0), ("z", 1.0)], "g string, v double")
    tr, te = en.group_mean_ratio(train, test, "g", "v", "r")
    got = {r.g: r.r for r in te.collect()}
    assert got["a"] == pytest.approx(2.0)
    assert got["new"] == pytest.approx(1.0)  # 2 / global train mean 2
    assert got["z"] is None  # zero group mean


def test_leakage_test_rows_never_change_fits(spark):
    """Fits read train only: scrambling every test value leaves them unchanged."""
    from cartlens.plans import training as tr
    rows = [(i, ["Cold", "Hot", "Cool"][i % 3], ["A", "B"][i % 2], ["S", "M"][i % 2 == 0],
             ["Fall", "Winter"][i % 4 == 0], "18-30", float(i % 17), float(i % 5)) for i in range(300)]
    schema = ("customer_id long, climate_group_new string, category string, size string, "
              "season string, age_new string, purchase_amount_usd double, frequency_value_new double")
    df = spark.createDataFrame(rows, schema)
    train, test = df.where("customer_id % 4 != 0"), df.where("customer_id % 4 = 0")
    scrambled = test.select("customer_id", *[F.lit("zzz").alias(c) for c in
                            ["climate_group_new", "category", "size", "season", "age_new"]],
                            F.lit(1e9).alias("purchase_amount_usd"), F.lit(-5.0).alias("frequency_value_new"))
    e1, e2 = tr.Encodings(), tr.Encodings()
    a_tr, _ = tr.add_encodings(train, test, e1)
    b_tr, _ = tr.add_encodings(train, scrambled, e2)
    for k in e1.conditionals:
        assert (sorted(e1.conditionals[k].counts.collect())
                == sorted(e2.conditionals[k].counts.collect()))
        assert e1.conditionals[k].train_mean == e2.conditionals[k].train_mean
    for k in e1.ratios:
        assert (sorted(e1.ratios[k].table.collect()) == sorted(e2.ratios[k].table.collect()))
        assert e1.ratios[k].global_mean == e2.ratios[k].global_mean
    assert sorted(map(tuple, a_tr.collect())) == sorted(map(tuple, b_tr.collect()))


def test_small_tables_are_broadcast_by_the_planner(spark):
    big = spark.range(50000).select((F.col("id") % 40).cast("string").alias("g"),
                                    (F.col("id") % 97).cast("string").alias("c"))
    out = en.apply_conditional(big, en.fit_conditional(big, "g", "c"), "p")
    out.write.format("noop").mode("overwrite").save()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_constant_feature_standardizes_to_zero(spark):
    df = spark.createDataFrame([(1.0, 3.0), (1.0, 5.0)], "a double, b double")
    s = en.fit_standardizer(df, ["a", "b"])
    r = s.transform(df, "z_").collect()
    assert [x.z_a for x in r] == [0.0, 0.0]
    assert [x.z_b for x in r] == [-1.0, 1.0]  # population std


def test_balanced_weights(spark):
    df = spark.createDataFrame([(1,), (1,), (1,), (0,)], "y int")
    w = {r.y: r.weight for r in en.balanced_weights(df, "y").collect()}
    assert w == {1: pytest.approx(4 / 6), 0: pytest.approx(2.0)}


def test_bucket_digits_grow_with_class_size():
    from cartlens.operators.ranking import bucket_digits
    assert bucket_digits(1000) == 3
    assert bucket_digits(10**10) == 4  # 65536 buckets -> ~150k rows each
    assert 16 ** bucket_digits(10**12) * 200_000 >= 10**12


def test_split_same_for_any_digits(spark):
    df = _frame(spark, 3001)
    a = en.stratified_split(df, "customer_id", "subscription_status", digits=1)
    b = en.stratified_split(df, "customer_id", "subscription_status", digits=4)
    key = lambda r: (r.customer_id, r.is_test)
    assert sorted(map(key, a.collect())) == sorted(map(key, b.collect()))


def test_batched_fits_equal_single_fits(spark):
    df = spark.range(3000).select(
        (F.col("id") % 6).cast("string").alias("g"), (F.col("id") % 7).cast("string").alias("a"),
        (F.col("id") % 3).cast("string").alias("b"), (F.col("id") % 11).cast("double").alias("v"),
        F.when(F.col("id") % 5 == 0, None).otherwise((F.col("id") % 4).cast("string")).alias("h"))
    many = en.fit_conditionals(df, "g", ["a", "b"])
    for c in ["a", "b"]:
        one = en.fit_conditional(df, "g", c)
        assert sorted(many[c].counts.collect()) == sorted(one.counts.collect())
        assert many[c].train_mean == pytest.approx(one.train_mean)
    for gm in en.fit_group_means_many(df, [("g", "v"), ("h", "v")]):
        one = en.fit_group_means(df, gm.group, "v")
        assert sorted(gm.table.collect()) == sorted(one.table.collect())
        assert gm.global_mean == pytest.approx(one.global_mean)


def test_one_hot_slots_of_many_levels(spark):
    """More levels than a range holds: slots are the levels' places, range by range."""
    levels = [f"v{(i * 7919) % 5000:05d}é" for i in range(5000)]
    rows = [(x, "only" if i % 3 else None, None) for i, x in enumerate(levels)] * 2
    df = spark.createDataFrame(rows, "a string, b string, c string")
    keys = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")
    old = {k: spark.conf.get(k) for k in keys}
    try:
        for values in (("false", "7"), ("true", "8")):
            for k, v in zip(keys, values, strict=True):
                spark.conf.set(k, v)
            got = {(r.column_name, r.level): r.slot
                   for r in en.one_hot_levels(df, ["a", "b", "c"]).collect()}
            want = {("a", x): i for i, x in enumerate(sorted(levels))} | {("b", "only"): 0}
            assert got == want
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert en.one_hot_levels(df.limit(0), ["a"]).count() == 0


def test_weights_do_not_gather_a_class_in_one_task(spark, tmp_path):
    """Rows keep their eight parts when written with their class's weight."""
    df = _frame(spark, 40_000).repartition(8).withColumn("x", F.md5(F.col("customer_id").cast("string")))
    at = str(tmp_path / "weighted")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")  # less than the rows
    try:
        en.with_weights(df, "subscription_status", "w").write.parquet(at)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    got = spark.read.parquet(at)
    per = got.groupBy(F.input_file_name().alias("f")).count().collect()
    assert len(per) == 8 and max(r["count"] for r in per) < 40_000 / 4
    w = {(r.subscription_status, r.w): r["count"]
         for r in got.groupBy("subscription_status", "w").count().collect()}
    assert w == {("Yes", 40_000 / (2 * 13_334)): 13_334, ("No", 40_000 / (2 * 26_666)): 26_666}

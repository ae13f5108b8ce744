"""Fits deal their rows to tasks by the size that they have in the fit's cache."""

import pytest
from pyspark.ml.classification import (GBTClassifier, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cartlens.plans import model as mo


@pytest.fixture(scope="module")
def rows(spark):
    x = [((F.col("customer_id") * k) % 97).cast("double") for k in (7, 31, 53, 89)]
    label = ((F.col("customer_id") * 31) % 97 + F.col("customer_id") % 11 > 50).cast("int")
    return spark.range(1, 801).withColumnRenamed("id", "customer_id").select(
        "customer_id", label.alias("label"), (F.col("customer_id") % 5).cast("int").alias("fold"),
        F.lit(1.0).alias("w"), array_to_vector(F.array(*x)).alias("raw"),
        array_to_vector(F.array(*x)).alias("features")).coalesce(1)


def forest(trees=10):
    return RandomForestClassifier(featuresCol="features", numTrees=trees, maxDepth=4, seed=1)


@pytest.fixture
def small_tasks(monkeypatch):
    monkeypatch.setattr(mo, "TASK_BYTES", 20_000)


@pytest.mark.parametrize("n", [720_000, 4_320_000, 100 * 720_000])
def test_task_bytes_do_not_grow_with_the_rows(n):
    for slots, trees in ((262, 200), (22, 100), (22, 0)):
        tasks = mo.fit_tasks(n, slots, trees, 12)
        assert n * (8 * slots + 8 * trees + 64) / tasks <= mo.TASK_BYTES
    assert mo.fit_tasks(1200, 262, 200, 12) == mo.fit_tasks(0, 262, 200, 12) == 1


def test_all_rows_are_spread_evenly(rows, small_tasks):
    for est in (forest(), LogisticRegression(), GBTClassifier()):
        out = mo.spread(est, rows)
        per = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert len(per) >= 4 and max(per) < 800 / len(per) * 2
        assert sorted(out.collect()) == sorted(rows.collect())


def test_spread_rows_without_the_key(rows, small_tasks):
    out = mo.spread(forest(), rows.drop("customer_id"))
    assert out.count() == 800 and out.rdd.getNumPartitions() >= 4


def test_few_or_no_rows_stay_as_they_are(rows):
    assert mo.spread(forest(), rows) is rows
    none = rows.where("false")
    assert mo.spread(forest(), none) is none


def test_a_forest_does_not_depend_on_the_files(rows, small_tasks):
    """One file or seven: the same bootstrap samples (not so before the spread)."""
    seven = rows.orderBy(F.desc("customer_id")).repartition(7)
    one, many = (mo.fit(forest(), r).toDebugString.split("\n", 1) for r in (rows, seven))
    assert one[1] == many[1]  # the first line names the model's uid
    imp = [mo.select_features(r, list("abcd"), trees=5)[1] for r in (rows, seven)]
    assert imp[0] == imp[1]


def test_every_fit_is_spread(rows, small_tasks, monkeypatch):
    seen = []
    dealt = mo.spread
    monkeypatch.setattr(mo, "spread", lambda est, train, *a: seen.append(
        (type(est).__name__, train.count())) or dealt(est, train, *a))
    gbt = GBTClassifier(featuresCol="features", maxIter=2, maxDepth=2)
    mo.cross_validate(rows, gbt)
    mo.fit_point(forest(3), rows, {mo.MIN_SPLIT: 2})
    mo.select_features(rows, list("abcd"), trees=3)
    assert seen == [("GBTClassifier", 640)] * 5 + [("RandomForestClassifier", 800)] * 2

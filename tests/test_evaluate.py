"""Evaluation operators against hand-computed and MLlib values."""

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cartlens.operators import evaluate as ev


def _scored(spark, n=3000):
    return spark.range(n).select(
        (((F.col("id") * 7919) % 1000) / 1000.0).alias("score"),
        F.when(((F.col("id") * 31) % 100) < (((F.col("id") * 7919) % 1000) / 12), 1).otherwise(0).alias("label"))


def test_tied_scores_half_credit(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5)], "label int, score double")
    assert ev.roc_auc(df).first()["auc"] == pytest.approx(0.5)
    pts = ev.roc_curve(df).collect()
    assert len(pts) == 2


def test_auc_matches_mllib_exact(spark):
    df = _scored(spark)
    ours = ev.roc_auc(df, buckets=16).first()["auc"]
    raw = df.select("label", array_to_vector(F.array(-F.col("score"), F.col("score"))).alias("rawPrediction"))
    ml = BinaryClassificationEvaluator(numBins=0).evaluate(raw.withColumn("label", F.col("label").cast("double")))
    assert ours == pytest.approx(ml, abs=1e-12)


def test_auc_of_negated_score(spark):
    df = _scored(spark)
    a = ev.roc_auc(df).first()["auc"]
    b = ev.roc_auc(df.withColumn("score", 1 - F.col("score"))).first()["auc"]
    assert a + b == pytest.approx(1.0)


def test_sweep_recall_never_rises(spark):
    rec = [r.recall for r in ev.threshold_sweep(_scored(spark)).orderBy("threshold").collect()]
    assert all(x >= y for x, y in zip(rec, rec[1:]))
    assert ev.sweep_thresholds()[7] == 0.4


def test_no_recall_default_threshold(spark):
    df = spark.createDataFrame([(1, 0.01), (0, 0.02), (1, 0.03)], "label int, score double")
    b = ev.best_threshold(ev.threshold_sweep(df)).first()
    assert b.threshold == 0.5 and b.found is False


def test_one_class(spark):
    df = spark.createDataFrame([(0, 0.2), (0, 0.7)], "label int, score double")
    m = ev.binary_metrics(df).first()
    assert (m.precision, m.recall, m.f1) == (0.0, 0.0, 0.0)
    assert ev.roc_auc(df).first()["auc"] is None


def test_classification_report_rows(spark):
    df = spark.createDataFrame([(1, 1), (0, 0), (1, 0), (0, 0)], "label int, pred int")
    rep = {r.row_label: r for r in ev.classification_report(df).collect()}
    assert rep["Yes"].recall == pytest.approx(0.5) and rep["No"].precision == pytest.approx(2 / 3)
    assert rep["accuracy"].precision == pytest.approx(0.75)


def test_crowded_scores_are_split(spark):
    """Nearly all scores below 0.0002: no range holds over a hundredth of them."""
    from cartlens.operators.evaluate import _score_table
    df = spark.range(100_000).select((F.col("id") % 3 == 0).cast("int").alias("label"),
                                     (F.col("id") * 2e-9).alias("score"))
    df = df.union(spark.createDataFrame([(1, 0.9), (0, -4.0), (1, 7.0)], "label int, score double"))
    t = _score_table(df, "label", "score", 256, False)
    sizes = [r["count"] for r in t.groupBy("b").count().collect()]
    assert sum(sizes) == 100_003 and max(sizes) <= 1_500


def test_auc_of_counts_beyond_long(spark):
    from unittest import mock
    t = spark.createDataFrame([(0.5, 4 * 10**9, 4 * 10**9, 0, 0, 1, 1, 0)],
                              "s double, pos long, neg long, pos_before long, neg_before long, "
                              "P long, N long, b int")
    with mock.patch("cartlens.operators.evaluate._score_table", return_value=t):
        assert ev.roc_auc(None).first()["auc"] == 0.5

"""Logistic fits that share their scans equal separate fits."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cartlens.plans import logistic as lo
from cartlens.plans import model as mo


def frame(spark, n=400, size=5, seed=1):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, size)) * np.linspace(0.5, 3, size)
    y = (x @ r.standard_normal(size) + r.standard_normal(n) * 2 > 0.7).astype(int)
    fold = np.arange(n) % 5
    rows = [(a.tolist(), int(b), int(c)) for a, b, c in zip(x, y, fold, strict=True)]
    df = spark.createDataFrame(rows, "x array<double>, label int, fold int")
    return x, y, fold, df.select(array_to_vector("x").alias("features"), "label", "fold")


def newton(x, y, penalty):
    a = np.column_stack((x, np.ones(len(x))))
    ridge = penalty * np.diag(np.r_[np.ones(x.shape[1]), 0])
    b = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ b))
        b -= np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) / len(a) + ridge,
                             a.T @ (p - y) / len(a) + ridge @ b)
    return b


def test_all_fits_equal_separate_newton(spark):
    x, y, fold, df = frame(spark)
    fits = [lo.Fit(f, c) for c in (1e-3, 0.05, 1.0) for f in (*range(5), None)]
    beta = lo.fit_all(df.repartition(7), fits)
    for j, fit in enumerate(fits):
        used = fold != fit.fold if fit.fold is not None else slice(None)
        assert np.abs(beta[:, j] - newton(x[used], y[used], fit.penalty)).max() < 1e-8


def test_scans_do_not_grow_with_fits(spark, monkeypatch):
    calls = []
    plain = lo._shares
    monkeypatch.setattr(lo, "_shares", lambda *a: calls.append(len(a[1])) or plain(*a))
    *_, df = frame(spark)
    counts = []
    for penalties in ([0.1], [0.1, 0.1, 0.1, 0.1]):
        calls.clear()
        lo.fit_all(df, [lo.Fit(f, c) for c in penalties for f in range(5)])
        counts.append(len(calls))
    assert counts[0] == counts[1] < 15


def test_cross_validation_equals_sparks_own_fits(spark):
    *_, df = frame(spark)
    est = LogisticRegression(maxIter=1000, tol=1e-12, regParam=0.01, standardization=False)
    grid = [{est.regParam: c} for c in (0.001, 0.1)]
    got = mo.cross_validate(df, est, grid)
    for i, params in enumerate(grid):
        auc = []
        for f in range(5):
            m = est.fit(df.where(F.col("fold") != f), params)
            auc.append(BinaryClassificationEvaluator(numBins=0).evaluate(
                m.transform(df.where(F.col("fold") == f))))
        assert got.avgMetrics[i] == pytest.approx(np.mean(auc), abs=1e-9)
        assert got.stdMetrics[i] == pytest.approx(np.std(auc), abs=1e-9)


def test_rows_of_one_class_and_no_rows(spark):
    *_, df = frame(spark)
    assert not lo.fit_all(df.where("label = 1"), [lo.Fit(0, 0.1)]).any()
    assert lo.fit_all(df.where("false"), [lo.Fit(0, 0.1)]).shape == (1, 1)

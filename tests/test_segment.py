"""Segmentation: silhouette against brute force, centroid assignment, k-means."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartlens.operators import segment as sg


def _brute_silhouette(x, lab):
    n = len(x)
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    out = []
    for i in range(n):
        own = lab == lab[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, lab == c].mean() for c in set(lab) if c != lab[i])
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def test_silhouette_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 3))
    lab = np.array([i % 4 for i in range(119)] + [9])  # one singleton cluster
    df = spark.createDataFrame([(int(c), *map(float, r)) for c, r in zip(lab, x)],
                               "cluster int, a double, b double, c double")
    got = sg.silhouette(df, ["a", "b", "c"]).first()["silhouette"]
    assert got == pytest.approx(_brute_silhouette(x, lab), abs=1e-9)


def test_nearest_centroid_tie_smallest(spark):
    df = spark.createDataFrame([(0.0,), (2.0,)], "a double")
    got = [r.segment for r in sg.assign_segment(df, ["a"], {1: [1.0], 0: [1.0], 2: [5.0]}).collect()]
    assert got == [0, 0]


def _points(spark, seed=0):
    rng = np.random.default_rng(seed)
    pts = np.vstack([rng.normal(c, 0.6, size=(60, 2)) for c in (0, 2, 5, 9)])
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(pts)]
    return pts, sg.assemble(spark.createDataFrame(rows, "id int, a double, b double"), ["a", "b"])


def test_restarts_together_equal_separate_runs(spark):
    pts, df = _points(spark)
    fits = sg.kmeans_restarts(df, k=4, seeds=range(42, 47))
    for f in fits:
        (alone,) = sg.kmeans_restarts(df, k=4, seeds=[f.seed])
        assert np.allclose(alone.centers, f.centers, rtol=1e-12)
        assert alone.cost == pytest.approx(f.cost, rel=1e-12)
        d = ((pts[:, None] - np.array(f.centers)[None]) ** 2).sum(2)
        assert f.cost == pytest.approx(d.min(1).sum())
        got = {r.id: r.raw_cluster for r in f.transform(df).collect()}
        assert [got[i] for i in range(len(pts))] == d.argmin(1).tolist()
    best = sg.kmeans_best(df, k=4, seed=42, restarts=5)
    assert best.cost == min(f.cost for f in fits)
    assert best.seed == min(f.seed for f in fits if f.cost == best.cost)


def test_lloyd_steps_equal_numpy(spark):
    pts, df = _points(spark, 3)
    rows = df.select(F.array("a", "b").alias("x"))
    starts = {7: pts[:4].tolist(), 8: pts[100:104].tolist(), 9: [[0.0, 0.0], [99.0, 99.0]]}
    for f in sg.lloyd(rows, starts, max_iter=6, tol=1e-9):
        c = np.array(starts[f.seed])
        for _ in range(6):
            own = ((pts[:, None] - c[None]) ** 2).sum(2).argmin(1)
            c = np.array([pts[own == j].mean(0) if (own == j).any() else c[j]
                          for j in range(len(c))])
        assert np.allclose(f.centers, c, atol=1e-9)


def test_kmeans_of_few_different_rows(spark):
    df = sg.assemble(spark.createDataFrame([(1.0,), (1.0,), (3.0,)], "a double"), ["a"])
    best = sg.kmeans_best(df, k=3, restarts=2)
    assert sorted(best.centers) == [[1.0], [3.0]] and best.cost == 0.0


def test_modes(spark):
    df = spark.createDataFrame([(1, "b", None), (1, "a", None), (1, None, None), (2, "z", "q"),
                                (2, "z", "p"), (2, "y", "p")], "g int, u string, v string")
    frame = sg.modes(df, "g", {"mu": "u", "mv": "v"})
    assert {tuple(r) for r in frame.collect()} == {(1, "a", None), (2, "z", "p")}
    assert "ObjectHashAggregate" not in frame._jdf.queryExecution().executedPlan().toString()


def test_renumber_by_mean(spark):
    df = spark.createDataFrame([(7, 10.0), (7, 12.0), (2, 1.0)], "raw int, v double")
    got = {r.raw: r.cluster for r in sg.renumber_by(df, "raw", "v").collect()}
    assert got == {2: 0, 7: 1}


def test_silhouette_of_coincident_points(spark):
    df = spark.createDataFrame([(1.0, 0), (1.0, 0), (1.0, 1), (1.0, 1)], "x double, cluster int")
    assert sg.silhouette(df, ["x"]).first()["silhouette"] == 0.0


def test_crm_means_use_all_decimals(spark):
    df = spark.createDataFrame([(1, 0.00049, "Yes", "No", 1.0, 2.0)] * 3, (
        "customer_id int, total_spend_weighted_new double, subscription_status string, "
        "promo_code_used string, previous_purchases double, frequency_value_new double")
        ).withColumn("cluster", F.lit(0))
    assert sg.crm_summary(df).first()["avg_spend"] == 0.0
    df = df.withColumn("total_spend_weighted_new", F.lit(0.00051))
    assert sg.crm_summary(df).first()["avg_spend"] == 0.001

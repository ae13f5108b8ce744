"""The selection forest of many rows: exact sums, MLlib's rules, no dependence on sizes."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cartlens.plans import forest
from cartlens.plans import model as mo


@pytest.fixture(scope="module")
def rows(spark):
    n = F.col("customer_id")
    x = [(n * 7 % 97).cast("double"), (n * 31 % 89 / 7.0), (n * 53 % 83 > 60).cast("double"),
         (n * 11 % 79 > 20).cast("double"), F.lit(3.0), (n * 17 % 73).cast("double")]
    label = (n * 7 % 97 + 40 * (n * 53 % 83 > 60).cast("int") + n * 13 % 29 > 60).cast("int")
    return spark.range(1, 3001).withColumnRenamed("id", "customer_id").select(
        "customer_id", label.alias("label"), F.when(label == 1, 0.8).otherwise(1.3).alias("w"),
        array_to_vector(F.array(*x)).alias("raw")).repartition(
            3, "customer_id").sortWithinPartitions("customer_id")


def test_selection_of_many_rows_caches_nothing_a_tree(rows, monkeypatch):
    """MLlib's forest keeps a count and a node of every tree beside each row; beyond one
    task it is not used any more, and the importances stay near its own."""
    mllib = RandomForestClassifier(featuresCol="raw", labelCol="label", weightCol="w",
                                   numTrees=30, seed=1, maxDepth=15).fit(rows)
    monkeypatch.setattr(mo, "TASK_BYTES", 200_000)
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda *a: pytest.fail("MLlib's forest"))
    keep, imp = mo.select_features(rows, list("abcdef"), trees=30)
    assert np.abs(np.array(imp) - mllib.featureImportances.toArray()).max() < 0.04
    assert sum(imp) == pytest.approx(1) and imp[4] == 0
    assert keep == [i for i, v in enumerate(imp) if v >= mo.MIN_IMPORTANCE]


def test_sizes_do_not_change_the_forest(rows, monkeypatch):
    def found():
        return forest.importances(rows, "raw", "label", "w", 4, 6, 5)

    first = found()
    for name, value in (("PIECE_BYTES", 20_000), ("CELLS", 64), ("STEP", 1), ("NODES", 1),
                        ("BLOCK", 2)):
        monkeypatch.setattr(forest, name, value)
    assert found() == first


def test_every_row_and_weight_is_summed(rows):
    """A tree's sample: each row by its Poisson count, in units of the largest weight."""
    depths, slots = forest.grow(rows, "raw", "label", "w", 20, 3, 5)
    unit = 1.3 / forest.UNITS
    weight = rows.agg(F.sum("w")).first()[0]
    assert slots == 6 and np.abs(depths[0].count * unit / weight - 1).max() < 0.1
    assert (depths[0].count * unit / weight).mean() == pytest.approx(1, abs=0.02)
    for above, below in zip(depths, depths[1:]):
        for t in range(20):  # open children hold what their parents held, less closed ones
            tree = [d.count[d.steps.start[t]:d.steps.start[t + 1]].sum() for d in (above, below)]
            assert tree[1] <= tree[0]


def test_best_split_by_hand():
    """Two nodes, three features of 3, 2 and 1 bins; the first bin is what is left."""
    rng = np.random.default_rng(3)
    subset, width = np.array([[0, 1, 2]] * 3), np.array([[3, 2, 1]] * 3)
    cells = rng.integers(1, 9, (2, 3, 6)).astype(float)  # class, node, cell
    whole = cells[:, :, :3].sum(axis=2)
    cells[:, :, 4] = np.minimum(cells[:, :, 4], whole - 1)
    cells[:, :, 3], cells[:, :, 5] = whole - cells[:, :, 4], whole
    cells[1, 2], whole[1, 2] = 0, 0  # one class: no split
    below = cells.copy()
    below[:, :, [0, 3, 5]] = 0
    gain, feature, cut, left, right = forest._best(
        np.concatenate([whole, below.reshape(2, -1)], axis=1), subset, width)

    def gini(v):
        return 1 - ((v / v.sum()) ** 2).sum()

    for k in range(2):
        best = (0, None)
        for f, c, part in ((0, 0, [0]), (0, 1, [0, 1]), (1, 0, [3])):
            a = cells[:, k, part].sum(axis=1)
            b = whole[:, k] - a
            g = gini(whole[:, k]) - (a.sum() * gini(a) + b.sum() * gini(b)) / whole[:, k].sum()
            if g > best[0] + 1e-12:
                best = (g, (f, c, a.tolist(), b.tolist()))
        assert gain[k] == pytest.approx(best[0])
        assert (feature[k], cut[k], left[:, k].tolist(), right[:, k].tolist()) == best[1]
    assert gain[2] == 0 and left[:, 2].tolist() == whole[:, 2].tolist()


def test_cut_points():
    assert forest._cut_points(np.array([1.0, 2.0, 4.0]), np.ones(3), 32) == [1.5, 3.0]
    assert forest._cut_points(np.array([7.0]), np.ones(1), 32) == []
    many = forest._cut_points(np.arange(6400.0), np.ones(6400), 32)
    assert len(many) == 31 and np.abs(np.diff(many) - 200).max() <= 1
    v, w = forest._thin(np.arange(50_000) % 20_000, np.ones(50_000))
    assert len(v) <= forest.VALUES and w.sum() == 50_000 and v[-1] == 19_999


def test_labels_and_weights_are_checked(rows):
    with pytest.raises(Exception, match="labels are 0, 1"):
        forest.grow(rows.withColumn("label", F.when(F.col("customer_id") != 7, F.col("label"))),
                    "raw", "label", "w", 2, 2, 5)

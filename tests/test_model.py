"""Model invariants: planted signal, determinism, save/load equality."""

import pytest
from pyspark.ml.classification import LogisticRegressionModel, RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from conftest import SF_CHECK
from cartlens import catalog
from cartlens.operators import evaluate as ev
from cartlens.plans import model as mo
from cartlens.sources import io


@pytest.fixture(scope="module")
def prepared(spark):
    return catalog.model_data(spark, SF_CHECK)


def test_planted_signal_auc(spark, prepared):
    lr = dict(mo.candidates(prepared.n_train))["LogisticRegression"].fit(prepared.train)
    auc = ev.roc_auc(mo.score(lr, prepared.test)).first()["auc"]
    assert auc > 0.75


def test_one_hot_width_independent_of_test(spark, prepared):
    assert len(prepared.names) == prepared.train.first()["raw"].size


def test_folds_stratified(spark, prepared):
    rows = prepared.train.groupBy("fold", "label").count().collect()
    by_label = {}
    for r in rows:
        by_label.setdefault(r.label, []).append(r["count"])
    for counts in by_label.values():
        assert len(counts) == 5 and max(counts) - min(counts) <= 1


def test_save_load_equal_scores(spark, prepared, tmp_path):
    lr = dict(mo.candidates(prepared.n_train))["LogisticRegression"].fit(prepared.train)
    io.save_bundle(str(tmp_path / "b"), {"m": lr}, {}, {"k": 1})
    models, _, meta = io.load_bundle(spark, str(tmp_path / "b"), {"m": LogisticRegressionModel})
    a = mo.score(lr, prepared.test).select("customer_id", "score")
    b = mo.score(models["m"], prepared.test).select("customer_id", F.col("score").alias("s2"))
    assert meta == {"k": 1}
    assert a.join(b, "customer_id").where(F.abs(F.col("score") - F.col("s2")) > 1e-12).count() == 0


def test_trained_path_reproduces_test_scores(spark, prepared):
    """Raw test customers scored through the stored fits equal the test split."""
    from cartlens import catalog
    lr = dict(mo.candidates(prepared.n_train))["LogisticRegression"].fit(prepared.train)
    ids = prepared.test.select("customer_id")
    raw = catalog.shop(spark, SF_CHECK).join(ids, "customer_id")
    a = mo.score(lr, prepared.test).select("customer_id", "score")
    b = mo.score(lr, mo.transform_new(raw, prepared)).select("customer_id", F.col("score").alias("s2"))
    j = a.join(b, "customer_id")
    assert j.count() == prepared.test.count()
    assert j.where(F.abs(F.col("score") - F.col("s2")) > 1e-9).count() == 0


def test_same_seed_same_model(spark, prepared):
    rf = dict(mo.candidates(prepared.n_train))["RandomForest"]
    a = rf.fit(prepared.train).featureImportances.toArray()
    b = rf.copy().fit(prepared.train).featureImportances.toArray()
    assert (a == b).all()


def test_score_requests_modes(spark, prepared):
    from cartlens import catalog
    from cartlens.plans.scoring import score_requests
    b = catalog.scoring_bundle(spark, SF_CHECK)
    req = catalog.shop(spark, SF_CHECK).limit(50)
    form = score_requests(req, b, "form").collect()
    trained = score_requests(req, b, "trained", prepared).collect()
    assert len(form) == len(trained) == 50
    assert all(0.0 <= r.probability <= 1.0 for r in trained)


def test_tune_forest_small_grid(spark, prepared):
    best, cvm = mo.tune(prepared, "RandomForest", {"numTrees": [5, 10]})
    assert len(cvm.avgMetrics) == 2
    assert best.getNumTrees in (5, 10)
    assert max(cvm.avgMetrics) == cvm.avgMetrics[[5, 10].index(best.getNumTrees)]


def walk(nodes, x, min_rows):
    """Class shares of the node of a saved tree where a row ends, with no node of
    fewer than ``min_rows`` rows split."""
    node = nodes[0]
    while node.leftChild >= 0 and node.rawCount >= min_rows:
        cut = node.split.leftCategoriesOrThreshold[0]
        node = nodes[node.leftChild if x[node.split.featureIndex] <= cut else node.rightChild]
    return [s / sum(node.impurityStats) for s in node.impurityStats]


@pytest.fixture(scope="module")
def forest(spark, tmp_path_factory):
    import random
    r = random.Random(3)
    rows = []
    for _ in range(600):
        x = [r.random() for _ in range(4)]
        rows.append((float(x[0] + x[1] * x[2] + r.gauss(0, 0.3) > 0.8), Vectors.dense(x),
                     1.0 + r.random()))
    df = spark.createDataFrame(rows, ["label", "features", "w"])
    model = RandomForestClassifier(numTrees=7, maxDepth=12, weightCol="w", seed=5).fit(df)
    path = str(tmp_path_factory.mktemp("forest") / "m")
    model.save(path)
    trees = {}
    for row in spark.read.parquet(path + "/data").collect():
        trees.setdefault(row.treeID, {})[row.nodeData.id] = row.nodeData
    return df, model, trees


@pytest.mark.parametrize("min_rows", [0, 2, 3, 5, 40, 100_000])
def test_pruned_forest_never_split_small_nodes(spark, forest, min_rows):
    df, model, trees = forest
    small = mo.prune(spark, model, min_rows)
    assert small.getNumTrees == model.getNumTrees and small.numFeatures == model.numFeatures
    for r in small.transform(df).collect():
        each = [walk(t, r.features.toArray(), min_rows) for t in trees.values()]
        want = sum(s[1] for s in each) / sum(map(sum, each))
        assert abs(r.probability[1] - want) < 1e-12
    nodes = small.totalNumNodes
    assert nodes == (model.totalNumNodes if min_rows <= 2 else nodes) <= model.totalNumNodes
    assert (nodes < model.totalNumNodes) == (min_rows > 2)
    if min_rows == 100_000:
        assert nodes == 7  # roots only


def test_points_of_one_forest_equal_their_own_fits(forest):
    df, _, _ = forest
    train = df.withColumn("fold", F.pmod(F.hash("w"), F.lit(3)))
    est = RandomForestClassifier(maxDepth=6, seed=2, weightCol="w")
    maps = [{est.numTrees: n, mo.MIN_SPLIT: b} for n in (2, 4) for b in (2, 30)]
    cv = mo.cross_validate(train, est, maps, folds=3)
    for m, got in zip(maps, cv.avgMetrics, strict=True):
        alone = [mo.auc_evaluator().evaluate(mo.fit_point(
            est, train.where(F.col("fold") != f), m).transform(train.where(F.col("fold") == f)))
            for f in range(3)]
        assert abs(sum(alone) / 3 - got) < 1e-12
    assert len(set(cv.avgMetrics)) == 4


def test_tune_chooses_the_rows_to_split(spark, prepared):
    best, cvm = mo.tune(prepared, "RandomForest", {"numTrees": [5], mo.MIN_SPLIT: [2, 50]})
    assert len(cvm.avgMetrics) == 2
    full = dict(mo.candidates(prepared.n_train))["RandomForest"].setParams(numTrees=5)
    nodes = full.fit(prepared.train).totalNumNodes
    assert (best.totalNumNodes < nodes) == (cvm.avgMetrics[1] > cvm.avgMetrics[0])


def test_default_grids_match_workflow_sizes(spark, prepared):
    sizes = {name: len(mo.grid_for(name, est, prepared.n_train))
             for name, est in mo.candidates(prepared.n_train)}
    assert sizes == {"LogisticRegression": 3, "RandomForest": 24,
                     "BoostedDepthwise": 18, "BoostedLeafwise": 18}
    est = dict(mo.candidates(prepared.n_train))["RandomForest"]
    assert len({tuple(sorted((getattr(k, "name", k), v) for k, v in m.items()))
                for m in mo.grid_for("RandomForest", est, prepared.n_train)}) == 24


def test_train_then_score_in_fresh_session(spark, prepared, tmp_path):
    """SURVEY 7.7: the saved scoring state scores identically in a new process."""
    import subprocess
    import sys

    from cartlens import catalog
    from cartlens.plans.bundle import save_scoring_state
    from cartlens.plans.scoring import score_requests
    b = catalog.scoring_bundle(spark, SF_CHECK)
    bundle_path, req_path, out_path = (str(tmp_path / n) for n in ("bundle", "req", "out"))
    save_scoring_state(bundle_path, prepared, b)
    req = catalog.shop(spark, SF_CHECK)
    req.write.parquet(req_path)
    repo = __import__("os").path.dirname(__import__("os").path.dirname(__file__))
    script = (
        "import sys; sys.path.insert(0, %r)\n"
        "from cartlens.session import local_session\n"
        "from cartlens.plans.bundle import load_scoring_state\n"
        "from cartlens.plans.scoring import score_requests\n"
        "spark = local_session(app='fresh')\n"
        "md, bundle = load_scoring_state(spark, %r)\n"
        "score_requests(spark.read.parquet(%r), bundle, 'trained', md).write.parquet(%r)\n"
    ) % (repo, bundle_path, req_path, out_path)
    subprocess.run([sys.executable, "-c", script], check=True, timeout=600,
                   capture_output=True)
    got = spark.read.parquet(out_path)
    want = score_requests(req, b, "trained", prepared)
    j = got.alias("g").join(want.alias("w"), "customer_id")
    assert j.count() == req.count()
    bad = j.where((F.abs(F.col("g.probability") - F.col("w.probability")) > 1e-12)
                  | (F.col("g.segment") != F.col("w.segment")))
    assert bad.count() == 0

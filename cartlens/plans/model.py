"""Subscription models on Spark ML: encode, select, scale, cross-validate,
tune, score and compare.

Stages
------
one-hot     StringIndexer(alphabetAsc, keep) + OneHotEncoder(dropLast): every
            level seen in train keeps a slot; unseen and NULL are all zeros.
select      a balanced 200-tree forest on unscaled features; slots with
            importance >= 0.01 are kept (top 20 when none qualifies).
            Rows of several tasks go to :mod:`.forest`, fewer to MLlib's.
scale       population-std standardisation of the kept slots, fitted on train.
candidates  logistic regression (C=1 as regParam=1/(C*n)), balanced random
            forest, and two boosted-tree stand-ins (depth-wise / leaf-count).
CV          5 stratified folds from an exact per-class hash rank; AUC exact
            (``numBins=0``); mean and population std per candidate.
pruning     the forest's grid varies the rows that a node needs to be split; one
            forest per fold serves all these values (:func:`prune`).
spread      a fit caches its rows far wider than they are stored, so they are dealt
            to tasks by the size they have there, not by file size (:func:`fit`).

Data work is distributed; the driver holds only fitted parameters, slot
names and metric rows.
"""

from __future__ import annotations

import math
import statistics
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression,
                                       RandomForestClassificationModel, RandomForestClassifier)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features as fe
from ..operators import encode as en
from ..operators import evaluate as ev
from ..operators.ranking import bucket_digits, bucketed_rank, hash_order
from ..session import materialize, scratch_table
from . import forest, logistic
from . import training as tr

SEED = 42
MIN_IMPORTANCE = 0.01
FALLBACK_TOP = 20
#: bytes of a fit's cached rows that a task holds at most, and that are worth a task
TASK_BYTES, MIN_TASK_BYTES = 128 << 20, 8 << 20
KEY = "customer_id"
#: grid key: rows that a forest's node needs to be split (no Spark parameter)
MIN_SPLIT = "minSamplesSplit"


# ---------------------------------------------------------------- D6 + assemble
def encoder_pipeline(frame: DataFrame, fill_nulls: bool = True) -> tuple[Pipeline, list, list]:
    """One-hot for string columns and assembly of all features into ``raw``."""
    cats = tr.categorical_columns(frame)
    nums = tr.numeric_columns(frame)
    stages = []
    if cats:  # one indexer for all columns: a single pass over the data
        stages.append(StringIndexer(inputCols=cats, outputCols=[f"{c}__idx" for c in cats],
                                    handleInvalid="keep", stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCols=[f"{c}__idx" for c in cats],
                                    outputCols=[f"{c}__oh" for c in cats], dropLast=True))
    stages.append(VectorAssembler(inputCols=nums + [f"{c}__oh" for c in cats],
                                  outputCol="raw", handleInvalid="error"))
    return Pipeline(stages=stages), cats, nums


def slot_names(df: DataFrame, col: str) -> list[str]:
    """Feature slot names from the ML attribute metadata of a vector column."""
    attrs = df.schema[col].metadata["ml_attr"]["attrs"]
    named = sorted((a["idx"], a["name"]) for group in attrs.values() for a in group)
    return [n for _, n in named]


# ---------------------------------------------------------------- fits
def fit_tasks(rows: int, slots: int, trees: int, cores: int) -> int:
    """Tasks for a fit on so many rows. A cached row has a number a slot, and a forest
    adds a bootstrap count and a node id a tree."""
    size = rows * (8 * slots + 8 * trees + 64)
    return max(-(-size // TASK_BYTES), min(cores, size // MIN_TASK_BYTES), 1)


def spread(est, train: DataFrame, at_once: int = 1, key: str = KEY) -> DataFrame:
    """``train`` dealt to the tasks that the fit needs, by ``key`` and in its order, so
    that neither files nor arrival decide a bootstrap sample. ``at_once`` fits share the
    cores. Rows that are worth one task only stay as they are."""
    first = train.select(est.getFeaturesCol()).first()
    if first is None:
        return train
    trees = est.getNumTrees() if isinstance(est, RandomForestClassifier) else 0
    cores = train.sparkSession.sparkContext.defaultParallelism
    n = fit_tasks(train.count(), first[0].size, trees, cores // max(1, at_once))
    if n == 1:
        return train
    if key not in train.columns:
        return train.repartition(n)
    return train.repartition(n, key).sortWithinPartitions(key)


def fit(est, train: DataFrame, params: dict | None = None, at_once: int = 1):
    """``est`` with ``params`` fitted on all of ``train``, spread over its tasks."""
    est = est.copy(params or {})
    return est.fit(spread(est, train, at_once))


# ---------------------------------------------------------------- D7, D8
def select_features(train: DataFrame, names: list[str], label: str = "label",
                    min_importance: float = MIN_IMPORTANCE, fallback: int | None = FALLBACK_TOP,
                    trees: int = 200) -> tuple[list[int], list[float]]:
    """Indices of slots whose forest importance is at least ``min_importance``."""
    weighted = train if "w" in train.columns else en.with_weights(train, label, "w")
    # node-id caching (checkpointed to the shared folder) avoids re-sending
    # the growing trees at every level; the fitted forest is identical
    rf = RandomForestClassifier(featuresCol="raw", labelCol=label, weightCol="w",
                                numTrees=trees, seed=SEED, maxDepth=15,
                                cacheNodeIds=True, checkpointInterval=10)
    dealt = spread(rf, weighted)
    if dealt is weighted:  # worth one task
        imp = rf.fit(weighted).featureImportances.toArray().tolist()
    else:
        imp = forest.importances(dealt, "raw", label, "w", trees, rf.getMaxDepth(), SEED)
    keep = [i for i, v in enumerate(imp) if v >= min_importance]
    if not keep and fallback:
        keep = sorted(range(len(imp)), key=lambda i: -imp[i])[:fallback]
    return keep, imp


# ---------------------------------------------------------------- D9 on vectors
@dataclass
class VectorScaler:
    mean: list
    std: list

    def transform(self, df: DataFrame, col: str = "sel", out: str = "features") -> DataFrame:
        m = F.array(*[F.lit(v) for v in self.mean])
        s = F.array(*[F.lit(v) for v in self.std])
        arr = F.transform(vector_to_array(col), lambda x, i: (x - m[i]) / s[i])
        return df.withColumn(out, array_to_vector(arr))


def fit_vector_scaler(train: DataFrame, col: str = "sel") -> VectorScaler:
    r = train.select(Summarizer.metrics("mean", "variance", "count").summary(F.col(col))
                     .alias("s")).first()["s"]
    n = r["count"]
    mean = r["mean"].toArray().tolist()
    var = r["variance"].toArray().tolist()
    std = [math.sqrt(v * (n - 1) / n) if n > 1 and v > 0 else 1.0 for v in var]
    return VectorScaler(mean, std)


# ---------------------------------------------------------------- F1-F4
def candidates(n_train: int, label: str = "label", weight: str = "w") -> list[tuple[str, object]]:
    return [
        ("LogisticRegression", LogisticRegression(
            featuresCol="features", labelCol=label, maxIter=1000, regParam=1.0 / n_train,
            elasticNetParam=0.0, standardization=False)),
        ("RandomForest", RandomForestClassifier(
            featuresCol="features", labelCol=label, weightCol=weight, numTrees=100,
            maxDepth=15, seed=SEED, cacheNodeIds=True, checkpointInterval=10)),
        ("BoostedDepthwise", GBTClassifier(
            featuresCol="features", labelCol=label, maxIter=100, maxDepth=6, stepSize=0.3,
            seed=SEED)),
        ("BoostedLeafwise", GBTClassifier(
            featuresCol="features", labelCol=label, maxIter=100, maxDepth=5, stepSize=0.1,
            seed=SEED)),
    ]


def grid_for(name: str, est, n_train: int):
    """The analysed workflow's grids, mapped to Spark parameters."""
    g = ParamGridBuilder()
    if name == "RandomForest":
        g = (g.addGrid(est.numTrees, [200, 400]).addGrid(est.maxDepth, [8, 12, 16])
             .addGrid(est.minInstancesPerNode, [1, 2]))
        return [m | {MIN_SPLIT: rows} for m in g.build() for rows in (2, 5)]
    elif name == "BoostedDepthwise":
        g = (g.addGrid(est.stepSize, [0.01, 0.05, 0.1]).addGrid(est.maxIter, [200, 400])
             .addGrid(est.maxDepth, [3, 5, 7]))
    elif name == "BoostedLeafwise":
        g = (g.addGrid(est.stepSize, [0.01, 0.05, 0.1]).addGrid(est.maxIter, [200, 400])
             .addGrid(est.maxDepth, [4, 5, 6]))
    else:
        g = g.addGrid(est.regParam, [1.0 / (c * n_train) for c in (0.1, 1.0, 10.0)])
    return g.build()


def prune(spark: SparkSession, model: RandomForestClassificationModel, min_rows: int
          ) -> RandomForestClassificationModel:
    """The forest in which a node of fewer than ``min_rows`` rows is a leaf.

    Rows are those of the tree's bootstrap sample, repeats included. A node never has
    more rows than its parent, so the nodes below a new leaf need no walk: the saved
    node table is changed row by row, and loading builds each tree from its root.
    A new leaf predicts by the class weights that the node had before its split.
    Every split node has two rows or more, so 2 or less gives the model itself.
    """
    if min_rows <= 2:
        return model
    full, pruned = scratch_table(spark, "forest"), scratch_table(spark, "forest-pruned")
    model.save(full)
    model.save(pruned)  # its metadata; the nodes are replaced
    node = F.col("nodeData")
    leaf = (node.withField("gain", F.lit(-1.0)).withField("leftChild", F.lit(-1))
            .withField("rightChild", F.lit(-1)).withField("split", F.struct(
                F.lit(-1).alias("featureIndex"),
                F.array().cast("array<double>").alias("leftCategoriesOrThreshold"),
                F.lit(-1).alias("numCategories"))))
    few = (node["leftChild"] >= 0) & (node["rawCount"] < min_rows)
    (spark.read.parquet(f"{full}/data").withColumn("nodeData", F.when(few, leaf).otherwise(node))
     .write.mode("overwrite").parquet(f"{pruned}/data"))
    return RandomForestClassificationModel.load(pruned)


def fit_point(est, train: DataFrame, params: dict):
    """The model of one grid point, ``MIN_SPLIT`` included."""
    model = fit(est, train, {k: v for k, v in params.items() if k != MIN_SPLIT})
    return prune(train.sparkSession, model, params[MIN_SPLIT]) if MIN_SPLIT in params else model


# ---------------------------------------------------------------- F5
def with_folds(df: DataFrame, key: str = "customer_id", label: str = "label",
               k: int = 5, seed: int = SEED, n_rows: int | None = None) -> DataFrame:
    """Stratified fold id: per-class hash rank modulo k (exact, partition-free).
    ``n_rows`` (if known) sizes the rank buckets."""
    digits = bucket_digits(n_rows) if n_rows else 3
    ranked = bucketed_rank(df, [label], hash_order(f"fold{seed}", key), [key], digits, "_r")
    return ranked.withColumn("fold", ((F.col("_r") - 1) % k).cast("int")).drop("_r")


def auc_evaluator(label: str = "label") -> BinaryClassificationEvaluator:
    return BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="rawPrediction",
                                         metricName="areaUnderROC", numBins=0)


@dataclass
class CvScores:
    """Per parameter map: mean and population standard deviation of the AUC."""
    avgMetrics: list
    stdMetrics: list


def cross_validate(train: DataFrame, est, grid=None, folds: int = 5, parallelism: int = 5
                   ) -> CvScores:
    """AUC on every stored fold of a model fitted on the others; nothing is refitted
    on all rows here. Ridge logistic regressions of all folds and penalties share
    every scan, unless they have too many features for that. Grid points that differ
    by ``MIN_SPLIT`` alone share a fold's forest. Other fits are independent, so up to
    ``parallelism`` run as concurrent Spark jobs."""
    from concurrent.futures import ThreadPoolExecutor

    maps = grid or [{}]
    if (penalties := _ridge(est, maps)) and logistic.fits_together(
            train.first()[est.getFeaturesCol()].size, folds * len(maps)):
        return _cross_validate_logistic(train, est, penalties, folds)

    def plain(params):
        return frozenset((k, v) for k, v in params.items() if k != MIN_SPLIT)

    def run(item):
        """AUC on one fold for every point that shares the fit."""
        fold, shared = item
        model = fit(est, train.where(F.col("fold") != fold), dict(shared), parallelism)
        held = train.where(F.col("fold") == fold)
        return {rows: auc_evaluator().evaluate(
            (model if rows is None else prune(train.sparkSession, model, rows))
            .transform(held))
            for rows in {m.get(MIN_SPLIT) for m in maps if plain(m) == shared}}

    jobs = [(f, m) for m in dict.fromkeys(map(plain, maps)) for f in range(folds)]
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        auc = dict(zip(jobs, pool.map(run, jobs), strict=True))
    per = [[auc[f, plain(m)][m.get(MIN_SPLIT)] for f in range(folds)] for m in maps]
    return CvScores([statistics.fmean(x) for x in per], [statistics.pstdev(x) for x in per])


def _ridge(est, maps: list) -> list[float] | None:
    """The penalty of every parameter map, if only ridge logistic regressions differ by it."""
    if not isinstance(est, LogisticRegression) or est.isSet(est.weightCol) or (
            est.getStandardization() or est.getElasticNetParam() or not est.getFitIntercept()):
        return None
    if any(p == MIN_SPLIT or p.name != "regParam" for m in maps for p in m):
        return None
    return [float(m.get(est.regParam, est.getRegParam())) for m in maps]


def _cross_validate_logistic(train: DataFrame, est, penalties: list[float], folds: int
                             ) -> CvScores:
    fits = [logistic.Fit(f, c) for c in penalties for f in range(folds)]
    features, label = est.getFeaturesCol(), est.getLabelCol()
    beta = logistic.fit_all(train, fits, features, label)
    scored = materialize(logistic.margins(
        train.select(features, label, "fold"), beta, fits, features).select(
            "fit", F.col(label).alias("label"), F.col("margin").alias("score")))
    auc = {r.fit: r.auc for r in ev.roc_auc(scored, by=["fit"]).collect()}  # one row a fit
    per = [[auc.get(j) or 0.0 for j in range(i, i + folds)] for i in range(0, len(fits), folds)]
    return CvScores([statistics.fmean(x) for x in per], [statistics.pstdev(x) for x in per])


# ---------------------------------------------------------------- assembled data
@dataclass
class ModelData:
    """Assembled train/test frames plus every fitted piece needed to turn new
    raw rows into the same feature vectors (see :func:`transform_new`)."""
    train: DataFrame
    test: DataFrame
    encoder: PipelineModel
    names: list
    keep: list
    importances: list
    scaler: VectorScaler
    n_train: int
    numeric: list = field(default_factory=list)
    encodings: object = None
    prep_state: object = None


def prepare_model_data(eng: DataFrame, select: bool = True, prep_state=None) -> ModelData:
    """Split, fit encodings on train, one-hot, select, scale; both sides
    materialised once so CV and fits read written data."""
    train, test = tr.split_frame(eng)
    encs = tr.Encodings()
    train, test = tr.add_encodings(train, test, encs)
    mtrain, mtest = tr.model_frame(train), tr.model_frame(test)
    pipe, _, nums = encoder_pipeline(mtrain)
    mtrain, mtest = fe.fill_zero(mtrain, nums), fe.fill_zero(mtest, nums)
    enc = pipe.fit(mtrain)
    atrain, atest = enc.transform(mtrain), enc.transform(mtest)
    names = slot_names(atrain, "raw")
    base_cols = ["customer_id", "label", "raw"]
    atrain = materialize(en.with_weights(atrain.select(*base_cols), "label", "w"))
    atest = materialize(atest.select(*base_cols))
    if select:
        keep, imp = select_features(atrain, names)
    else:
        keep, imp = list(range(len(names))), []
    slicer = VectorSlicer(inputCol="raw", outputCol="sel", indices=keep)
    strain, stest = slicer.transform(atrain), slicer.transform(atest)
    scaler = fit_vector_scaler(strain)
    n_train = atrain.count()  # a written table: cheap
    ftrain = materialize(with_folds(scaler.transform(strain), n_rows=n_train))
    ftest = materialize(scaler.transform(stest))
    return ModelData(ftrain, ftest, enc, names, keep, imp, scaler, n_train,
                     nums, encs, prep_state)


def transform_new(raw: DataFrame, md: ModelData, features: tuple = ()) -> DataFrame:
    """H1 in trained mode: raw customer rows -> the model's scaled feature
    vector, reusing every fitted piece (labels, cuts, encodings, one-hot,
    selected slots, scaler). Row-wise apart from the fitted-table lookups.
    ``features`` names prepared columns to keep alongside the vector."""
    from .prepare import apply_prepared
    eng = apply_prepared(raw, md.prep_state)
    eng = eng.withColumns({f"__keep_{c}": F.col(c) for c in features}) if features else eng
    mf = tr.model_frame(tr.apply_encodings(eng, md.encodings),
                        carry=tuple(f"__keep_{c}" for c in features))
    mf = fe.fill_zero(mf, md.numeric)
    a = md.encoder.transform(mf).select(
        "customer_id", "raw", *[F.col(f"__keep_{c}").alias(c) for c in features])
    sel = VectorSlicer(inputCol="raw", outputCol="sel", indices=md.keep).transform(a)
    return md.scaler.transform(sel)


def score(model, df: DataFrame) -> DataFrame:
    """F8: probability of the positive class as ``score``."""
    return model.transform(df).withColumn("score", vector_to_array("probability")[1])


def compare_cv(p: ModelData, names: list[str] | None = None, parallel: int = 4
               ) -> tuple[DataFrame, str]:
    """F5 + F6: (model, cv_auc_mean, cv_auc_std, position) and the winner.

    Candidates are cross-validated as concurrent Spark jobs, each with its folds
    as concurrent jobs too; the winner is the highest mean, first on ties.
    """
    from concurrent.futures import ThreadPoolExecutor
    n_fit = max(1, round(p.n_train * 4 / 5))  # rows of each CV fit
    chosen = [(i, name, est) for i, (name, est) in enumerate(candidates(n_fit))
              if names is None or name in names]

    def run(item):
        i, name, est = item
        cvm = cross_validate(p.train, est)
        return (name, float(cvm.avgMetrics[0]), float(cvm.stdMetrics[0]), i)

    with ThreadPoolExecutor(max_workers=max(1, min(parallel, len(chosen)))) as pool:
        rows = sorted(pool.map(run, chosen), key=lambda r: r[3])
    spark = p.train.sparkSession
    df = spark.createDataFrame(rows, "model string, cv_auc_mean double, cv_auc_std double, "
                                     "position int")
    return df, pick_best(df)


def tune(p: ModelData, name: str, grid: dict | None = None):
    """grid search by 5-fold AUC; returns the best model, refitted on all of
    train, and the scores of the grid.

    ``grid`` maps parameter names to value lists and replaces the default grid
    of the candidate (for example a 2-point grid in tests). The default grid's
    regularisation stands for a C over the rows of a fit, so it is built once for
    the rows of a fold's fit and once for all of train.
    """
    def build(rows):
        est = dict(candidates(rows))[name]
        if grid is None:
            return est, grid_for(name, est, rows)
        b = ParamGridBuilder()
        for param, values in grid.items():
            if param != MIN_SPLIT:
                b = b.addGrid(est.getParam(param), list(values))
        bounds = [{MIN_SPLIT: rows} for rows in grid.get(MIN_SPLIT, ())] or [{}]
        return est, [m | bound for m in b.build() for bound in bounds]

    scores = cross_validate(p.train, *build(max(1, round(p.n_train * 4 / 5))))
    best = max(range(len(scores.avgMetrics)), key=lambda i: (scores.avgMetrics[i], -i))
    est, maps = build(p.n_train)
    return fit_point(est, p.train, maps[best]), scores


def winner(cv: DataFrame) -> DataFrame:
    """the candidate with the highest mean CV AUC, the first on ties; one row."""
    return cv.agg(F.min_by("model", F.struct(-F.col("cv_auc_mean"), F.col("position")))
                  .alias("model"))


def pick_best(cv: DataFrame) -> str:
    return winner(cv).first()["model"]


def top_importance(model, names: list[str], n: int = 20) -> DataFrame:
    """G8: feature importances of a tree model, largest first."""
    spark = SparkSession.getActiveSession()
    rows = [(f, float(v)) for f, v in zip(names, model.featureImportances.toArray())]
    df = spark.createDataFrame(rows, "feature string, importance double")
    return df.orderBy(F.desc("importance"), "feature").limit(n)


def top_coefficients(model, names: list[str], n: int = 20) -> DataFrame:
    """G9: coefficients with odds ratios, by absolute size."""
    spark = SparkSession.getActiveSession()
    rows = [(f, float(c)) for f, c in zip(names, model.coefficients.toArray())]
    df = spark.createDataFrame(rows, "feature string, coef double")
    return (df.withColumn("odds_ratio", F.exp("coef"))
            .orderBy(F.desc(F.abs("coef")), "feature").limit(n))


def compare_models(md: ModelData, names: list[str] | None = None) -> DataFrame:
    """G10: every candidate fitted on train and scored on test; metrics at the
    default 0.50 and at the best threshold for recall >= 0.85, and AUC."""
    from concurrent.futures import ThreadPoolExecutor

    from ..operators import evaluate as ev
    spark = md.train.sparkSession
    chosen = [(pos, name, est) for pos, (name, est) in enumerate(candidates(md.n_train))
              if names is None or name in names]

    def run(item):  # one candidate: fit, score, metrics (independent Spark jobs)
        pos, name, est = item
        sc = materialize(score(fit(est, md.train, at_once=len(chosen)), md.test).select("label", "score"))
        thr = ev.best_threshold(ev.threshold_sweep(sc)).first()["threshold"]
        at = ev.binary_metrics(sc, threshold=thr).first()
        d = ev.binary_metrics(sc).first()
        auc = ev.roc_auc(sc).first()["auc"]
        return (name, pos, float(thr), d["precision"], d["recall"], d["f1"],
                at["precision"], at["recall"], at["f1"], at["accuracy"],
                float(auc) if auc is not None else None)

    with ThreadPoolExecutor(max_workers=max(1, len(chosen))) as pool:
        rows = sorted(pool.map(run, chosen), key=lambda r: r[1])
    return spark.createDataFrame(
        rows, "model string, position int, threshold double, precision_default double, "
              "recall_default double, f1_default double, precision double, recall double, "
              "f1 double, accuracy double, auc double")

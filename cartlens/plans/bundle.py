"""Persist everything needed to score new customers, and load it in a fresh session.

Saved under one folder (on shared storage, e.g. under ``spark.checkpoint.dir``):
  models/encoder   the fitted one-hot + assembler ``PipelineModel``
  models/model     the fitted classifier
  tables/...       conditional counts and group means (parquet)
  meta             JSON: frequent labels, cut points, top locations, dropped
                   columns, kept slots, scaler, threshold, segment scaler and
                   centroids
Loading gives a :class:`~cartlens.plans.model.ModelData` (without the
training frames) for :func:`~cartlens.plans.model.transform_new` and a
:class:`~cartlens.plans.scoring.ScoringBundle` for ``score_requests``.
"""

from __future__ import annotations

from dataclasses import asdict

from pyspark.ml import PipelineModel
from pyspark.ml.classification import (GBTClassificationModel, LogisticRegressionModel,
                                       RandomForestClassificationModel)
from pyspark.sql import SparkSession

from ..operators.encode import ConditionalTable, GroupMeans, Standardizer
from ..sources import io
from . import training as tr
from .model import ModelData, VectorScaler
from .prepare import Prepared
from .scoring import ScoringBundle


# the fitted form of every candidate
MODEL_CLASSES = {c.__name__: c for c in (LogisticRegressionModel, RandomForestClassificationModel,
                                         GBTClassificationModel)}


def save_scoring_state(path: str, md: ModelData, bundle: ScoringBundle) -> None:
    tables, conds, ratios = {}, {}, {}
    for out, t in md.encodings.conditionals.items():
        conds[out] = {"group": t.group, "cat": t.cat, "smoothing": t.smoothing,
                      "n_cats": t.n_cats, "train_mean": t.train_mean}
        tables[f"cond__{out}"] = t.counts
    for out, g in md.encodings.ratios.items():
        ratios[out] = {"group": g.group, "value": g.value, "global_mean": g.global_mean}
        tables[f"ratio__{out}"] = g.table
    meta = {
        "prep_state": asdict(md.prep_state),
        "conditionals": conds, "ratios": ratios,
        "names": md.names, "keep": md.keep, "numeric": md.numeric,
        "scaler": {"mean": md.scaler.mean, "std": md.scaler.std},
        "threshold": bundle.threshold, "slots": bundle.slots,
        "seg_scaler": {"cols": bundle.seg_scaler.cols, "means": bundle.seg_scaler.means,
                       "stds": bundle.seg_scaler.stds},
        "centroids": {str(k): v for k, v in bundle.centroids.items()},
        "segment_names": {str(k): v for k, v in bundle.names.items()},
    }
    meta["model_class"] = type(bundle.model).__name__
    io.save_bundle(path, {"encoder": md.encoder, "model": bundle.model}, tables, meta)


def load_scoring_state(spark: SparkSession, path: str) -> tuple[ModelData, ScoringBundle]:
    models, tables, meta = io.load_bundle(spark, path, lambda meta: {
        "encoder": PipelineModel, "model": MODEL_CLASSES[meta["model_class"]]})
    enc = tr.Encodings()
    for out, c in meta["conditionals"].items():
        enc.conditionals[out] = ConditionalTable(
            c["group"], c["cat"], tables[f"cond__{out}"], c["smoothing"], c["n_cats"],
            c["train_mean"])
    for out, g in meta["ratios"].items():
        enc.ratios[out] = GroupMeans(g["group"], g["value"], tables[f"ratio__{out}"],
                                     g["global_mean"])
    scaler = VectorScaler(meta["scaler"]["mean"], meta["scaler"]["std"])
    md = ModelData(None, None, models["encoder"], meta["names"], meta["keep"], [], scaler, 0,
                   meta["numeric"], enc, Prepared(**meta["prep_state"]))
    ss = meta["seg_scaler"]
    bundle = ScoringBundle(
        models["model"], meta["slots"], scaler, meta["threshold"],
        Standardizer(ss["cols"], ss["means"], ss["stds"]),
        {int(k): v for k, v in meta["centroids"].items()},
        {int(k): v for k, v in meta["segment_names"].items()})
    return md, bundle

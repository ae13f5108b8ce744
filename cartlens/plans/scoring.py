"""Batch scoring of customers (the reference's single-customer form, as a job).

``request_features``  H1: the form's features. ``mode="form"`` keeps the form
                      rules (unknown frequency -> 12, fixed loyalty cuts
                      <13/<25/<38, non-Male counts as Female).
``align``             H2: one column per model slot in stored order; slots
                      the request cannot fill are 0 *before* scaling.
``score_requests``    H3 + H4: probability, decision at the saved threshold,
                      nearest segment and its name.
All per-row work is native expressions; the model is any fitted candidate,
applied by ``transform``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import features as fe
from ..functions import lookups as L
from ..operators.encode import Standardizer
from ..operators.segment import nearest_centroid
from .model import VectorScaler, score

FORM_NUMERIC = ["total_spend_weighted_new", "spend_per_purchase_new", "frequency_value_new",
                "loyalty_score_new", "high_review_rating_new", "spend_rating_new",
                "promo_x_loyalty", "promo_x_freq"]


def request_features(df: DataFrame) -> DataFrame:
    """H1 (form mode): the features a scoring request can supply."""
    spend, prev, rating = (F.col("purchase_amount_usd"), F.col("previous_purchases"),
                           F.col("review_rating"))
    freq = fe.map_expr("frequency_of_purchases", L.FREQUENCY_PER_YEAR, 12).cast("double")
    loyalty = (F.when(prev < 13, 1).when(prev < 25, 2).when(prev < 38, 3).otherwise(4))
    promo = fe.flag_expr(F.col("promo_code_used") == "Yes")
    male = fe.flag_expr(F.col("gender") == "Male")
    return df.withColumns({
        "total_spend_weighted_new": prev * spend,
        "spend_per_purchase_new": F.try_divide(spend, prev + F.lit(1)),
        "frequency_value_new": freq,
        "loyalty_score_new": loyalty,
        "high_review_rating_new": fe.flag_expr(rating >= 4),
        "spend_rating_new": spend * rating,
        "promo_x_loyalty": promo * loyalty,
        "promo_x_freq": promo * freq,
        "gender__oh_Male": male,
        "gender__oh_Female": 1 - male,
    })


def slot_value(slot: str, columns: list[str]):
    """Value of one model slot from request columns; 0 when not supplied."""
    if slot in columns:
        return F.coalesce(F.col(slot).cast("double"), F.lit(0.0))
    if slot.startswith("category__oh_"):
        level = slot[len("category__oh_"):]
        return fe.flag_expr(F.col("category") == level).cast("double")
    return F.lit(0.0)


def align(df: DataFrame, slots: list[str], out: str = "sel") -> DataFrame:
    """H2: assemble the stored slots in order, zeros for absent ones."""
    cols = df.columns
    tmp = [f"__s{i}" for i in range(len(slots))]
    x = df.withColumns({t: slot_value(s, cols) for t, s in zip(tmp, slots)})
    return VectorAssembler(inputCols=tmp, outputCol=out).transform(x).drop(*tmp)


@dataclass
class ScoringBundle:
    model: object          # any fitted candidate
    slots: list            # kept slot names, in model order
    scaler: VectorScaler
    threshold: float
    seg_scaler: Standardizer
    centroids: dict        # segment id -> centroid in standardised space
    names: dict


def score_requests(df: DataFrame, b: ScoringBundle, mode: str = "form",
                   model_data=None) -> DataFrame:
    """H3 + H4: probability, decision and segment for every request row.

    ``mode="form"`` builds the form's features (parity with the analysed
    simulator). ``mode="trained"`` sends full customer rows through every
    stored fit (:func:`cartlens.plans.model.transform_new`); recommended.
    """
    if mode == "trained":
        from .model import transform_new
        if model_data is None:
            raise ValueError("mode='trained' needs the fitted model data")
        # segments see the features that training saw, not the form's
        scored = score(b.model, transform_new(df, model_data, features=L.SEGMENT_FEATURES))
    elif mode == "form":
        scored = score(b.model, b.scaler.transform(align(request_features(df), b.slots)))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    z = b.seg_scaler.transform(scored.withColumns({
        c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in L.SEGMENT_FEATURES}),
        prefix="z_")
    zc = [f"z_{c}" for c in L.SEGMENT_FEATURES]
    seg = nearest_centroid(zc, b.centroids)
    return z.select(
        "customer_id", F.col("score").alias("probability"),
        (F.col("score") >= F.lit(b.threshold)).alias("subscribes"),
        seg.alias("segment"),
        fe.map_expr(seg, b.names, L.DEFAULT_SEGMENT_NAME).alias("segment_name"))

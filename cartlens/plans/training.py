"""Train-side preparation: split, then fit encodings on train and apply to both.

Mirrors the order of the analysed workflow: conditional probabilities of
category/size/season given climate (+ their product), four group-mean
ratios, then the model frame (drop raw and leaky columns).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import features as fe
from ..functions import lookups as L
from ..operators import encode as en
from ..session import materialize

PROB_COLUMNS = [("category", "p_category_given_climate_new"),
                ("size", "p_size_given_climate_new"),
                ("season", "p_season_given_climate_new")]
FIT_SCORE = "climate_item_fit_score_new"
RATIOS = [("category", "purchase_amount_usd", "rel_spend_cat_new"),
          ("climate_group_new", "purchase_amount_usd", "purchase_amt_rel_climate_new"),
          ("age_new", "purchase_amount_usd", "rel_spend_age_new"),
          ("climate_group_new", "frequency_value_new", "rel_freq_climate_new")]


@dataclass
class Encodings:
    """Everything fitted on train: conditional tables and group means."""
    conditionals: dict = field(default_factory=dict)
    ratios: dict = field(default_factory=dict)


def split_frame(eng: DataFrame, seed: int = 42, test_size: float = 0.2
                ) -> tuple[DataFrame, DataFrame]:
    """Exact stratified split; the flagged frame is materialised once so the
    many fits that follow read it instead of re-running the preparation."""
    flagged = materialize(en.stratified_split(eng, "customer_id", "subscription_status",
                                              test_size, seed))
    return (flagged.where(~F.col("is_test")).drop("is_test"),
            flagged.where(F.col("is_test")).drop("is_test"))


def add_encodings(train: DataFrame, test: DataFrame, enc: Encodings | None = None
                  ) -> tuple[DataFrame, DataFrame]:
    enc = enc if enc is not None else Encodings()
    # all fits read train once per family: one scan for the three conditional
    # tables, one for the four group-mean tables
    tables = en.fit_conditionals(train, "climate_group_new", [c for c, _ in PROB_COLUMNS], 1.0)
    means = en.fit_group_means_many(train, [(g, v) for g, v, _ in RATIOS])
    for cat, out in PROB_COLUMNS:
        t = tables[cat]
        enc.conditionals[out] = t
        train = en.apply_conditional(train, t, out)
        test = en.apply_conditional(test, t, out)
        test = en.fill_with_train_mean(train, test, out, t.train_mean)
    cols = [c for _, c in PROB_COLUMNS]
    train = en.fit_score(train, cols, FIT_SCORE)
    test = en.fit_score(test, cols, FIT_SCORE)
    for (group, value, out), gm in zip(RATIOS, means):
        enc.ratios[out] = gm
        train = en.apply_group_means(train, gm, out, fill_unseen=False)
        test = en.apply_group_means(test, gm, out, fill_unseen=True)
    return train, test


def apply_encodings(df: DataFrame, enc: Encodings) -> DataFrame:
    """Apply fitted encodings to new rows, the way test rows get them."""
    for _, out in PROB_COLUMNS:
        t = enc.conditionals[out]
        df = en.apply_conditional(df, t, out)
        if t.train_mean is not None:
            df = df.withColumn(out, F.coalesce(F.col(out), F.lit(t.train_mean)))
    df = en.fit_score(df, [c for _, c in PROB_COLUMNS], FIT_SCORE)
    for _, _, out in RATIOS:
        df = en.apply_group_means(df, enc.ratios[out], out, fill_unseen=True)
    return df


def model_frame(df: DataFrame, carry: tuple = ()) -> DataFrame:
    """Drop raw/identifier columns and leaky features; keep the label.
    ``carry`` passes named raw columns through untouched (for scoring)."""
    label = (fe.flag_expr(F.col("subscription_status") == "Yes")
             if "subscription_status" in df.columns else F.lit(0)).alias("label")
    keep = fe.drop_prefixed(fe.drop_present(df, L.MODEL_DROP_COLUMNS), L.LEAKAGE_PREFIXES)
    extra = [c for c in carry if c not in keep.columns and c in df.columns]
    return df.select("customer_id", label, *keep.columns, *extra)


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if f.dataType.simpleString() == "string" and f.name not in ("customer_id",)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if f.dataType.simpleString() in ("double", "int", "bigint", "float")
            and f.name not in ("customer_id", "label")]

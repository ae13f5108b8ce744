"""Preparation plan: clean -> engineer features (one lazy plan).

The only driver round-trips are bounded scalars: frequent labels (<= 100 per
column), Cramer's V, two sets of four quartile edges and the top-10 labels.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import features as fe
from ..functions import lookups as L
from ..operators import stats as st
from ..session import materialize
from ..sources.io import coerce_numeric


@dataclass
class Prepared:
    """Cut points and labels fitted while preparing; reusable on new data."""
    amount_edges: list[float] = field(default_factory=list)
    previous_edges: list[float] = field(default_factory=list)
    top_locations: list[str] = field(default_factory=list)
    cramers_v: float | None = None
    dropped: list[str] = field(default_factory=list)
    frequent: dict = field(default_factory=dict)


def clean(raw: DataFrame, state: Prepared | None = None) -> DataFrame:
    """Collapse rare labels in every string column, then drop a redundant flag."""
    state = state if state is not None else Prepared()
    kept, rare = st.frequent_label_counts(raw, st.string_columns(raw))
    state.frequent = {c: list(v) for c, v in kept.items()}
    if "location" in kept and not state.top_locations:
        # top locations of the collapsed column come from the same counts
        state.top_locations = st.top_after_collapse(kept["location"], rare["location"],
                                                    L.TOP_LOCATIONS)
    df = st.collapse_rare(raw, keep=state.frequent)
    df, v = st.drop_redundant(df)
    state.cramers_v = v
    state.dropped = [c for c in raw.columns if c not in df.columns]
    return df


def engineer(df: DataFrame, state: Prepared | None = None) -> DataFrame:
    """Derived columns in the analysed code's order (18 inputs -> 38 columns).

    Quartile cuts and the top locations are fitted here unless ``state``
    already carries them (then the same cuts are reused).
    """
    state = state if state is not None else Prepared()
    df = coerce_numeric(df)
    if not state.amount_edges or not state.previous_edges:
        edges = fe.qcut_edges_multi(df, {"purchase_amount_usd": 4, "previous_purchases": 4})
        state.amount_edges = state.amount_edges or edges["purchase_amount_usd"]
        state.previous_edges = state.previous_edges or edges["previous_purchases"]
    if not state.top_locations:
        state.top_locations = st.top_labels(df, "location", L.TOP_LOCATIONS)

    target = fe.target_expr(df)
    promo = fe.flag_expr(F.col("promo_code_used") == "Yes")
    amount, prev = F.col("purchase_amount_usd"), F.col("previous_purchases")
    freq_value = fe.map_expr("frequency_of_purchases", L.FREQUENCY_PER_YEAR).cast("double")
    loyalty_score = fe.cut_expr(prev, state.previous_edges, [1, 2, 3, 4],
                                include_lowest=True).cast("int")
    cols = {
        "total_spend_weighted_new": prev * amount,
        "spend_per_purchase_new": F.try_divide(amount, prev + F.lit(1)),
        "frequency_value_new": freq_value,
        "payment_type_new": fe.map_expr("payment_method", L.PAYMENT_TYPE),
        "age_new": fe.cut_expr("age", L.AGE_EDGES, L.AGE_LABELS),
        "purchase_amount_usd_new": fe.cut_expr(amount, state.amount_edges, L.LEVEL_LABELS,
                                               include_lowest=True),
        "loyalty_level_new": fe.cut_expr(prev, L.LOYALTY_EDGES, L.LEVEL_LABELS,
                                         include_lowest=True),
        "sub_freq_new": F.concat(fe.as_label(target), F.lit("_"),
                                 fe.as_label("frequency_of_purchases")),
        "promo_no_sub_new": fe.flag_expr((F.col("promo_code_used") == "Yes") & (target == 0)),
        "ship_sub_new": F.concat(fe.as_label("shipping_type"), F.lit("_"), fe.as_label(target)),
        "season_category_new": F.concat(fe.as_label("season"), F.lit("_"), fe.as_label("category")),
        "season_color_new": F.concat(fe.as_label("season"), F.lit("_"), fe.as_label("color")),
        "item_category_new": F.concat(fe.as_label("category"), F.lit("_"),
                                      fe.as_label("item_purchased")),
        "high_review_rating_new": fe.flag_expr(F.col("review_rating") >= 4),
        "spend_rating_new": amount * F.col("review_rating"),
        "location_grouped_new": F.when(F.col("location").isin(state.top_locations),
                                       F.col("location")).otherwise(F.lit("Other")),
        "climate_group_new": fe.climate_expr("location"),
        "loyalty_score_new": loyalty_score,
        "promo_x_loyalty": promo * loyalty_score,
        "promo_x_freq": promo.cast("double") * freq_value,
    }
    return df.select(*df.columns, *[e.alias(n) for n, e in cols.items()])


def prepare(raw: DataFrame, state: Prepared | None = None,
            materialize_input: bool = True) -> DataFrame:
    """clean + engineer. The input is materialised first (see
    :func:`cartlens.session.materialize`) because fitting the cuts takes
    several passes over it."""
    state = state if state is not None else Prepared()
    if materialize_input:
        raw = materialize(raw)
    return engineer(clean(raw, state), state)


def apply_prepared(raw: DataFrame, state: Prepared) -> DataFrame:
    """Prepare new rows exactly like the fitted data: stored frequent labels,
    the same dropped columns, stored cut points and top locations. No refit."""
    df = st.collapse_rare(raw, keep=state.frequent)
    df = df.drop(*[c for c in state.dropped if c in df.columns])
    return engineer(df, state)

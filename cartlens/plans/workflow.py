"""The whole analysis on one customer table, written as result tables.

    python -m cartlens.plans.workflow --input customers.csv --format csv --out <dir>

``analyse`` runs, in the analysed workflow's order: cleaning and features;
the EDA tables (KPIs, distributions, cross-tabs, Cramer's V, rates, densities);
segmentation (k-means, silhouette, profiles, CRM summary); the model path
(split, encodings, selection, CV of the candidates, tuning, threshold,
reports); and the saved scoring state. Each result is written as parquet
under ``out/<name>``; every step is a Spark job over the whole table.
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..operators import evaluate as ev
from ..operators import segment as sg
from ..operators import stats as st
from ..session import materialize
from . import model as mo
from .bundle import save_scoring_state
from .prepare import Prepared, prepare
from .scoring import ScoringBundle


def _write(df: DataFrame, out: str, name: str) -> None:
    df.write.mode("overwrite").parquet(os.path.join(out, name))


def analyse(raw: DataFrame, out: str, candidates: list[str] | None = None,
            restarts: int = 10) -> dict:
    """Run the workflow on ``raw`` (the 18 customer columns); returns a summary."""
    spark = raw.sparkSession
    raw = materialize(raw)
    state = Prepared()
    eng = materialize(prepare(raw, state, materialize_input=False))
    summary = {"cramers_v": state.cramers_v, "dropped": state.dropped}

    # EDA
    _write(st.kpis(raw), out, "kpis")
    _write(st.value_counts_many(raw, ["gender", "subscription_status", "size", "category"]),
           out, "value_counts")
    _write(st.crosstab_pct(raw, "discount_applied", "promo_code_used", ["No", "Yes"]),
           out, "crosstab_discount_promo")
    for a in ("promo_code_used", "gender"):
        _write(st.crosstab_pct(raw, a, "subscription_status", ["No", "Yes"]), out,
               f"crosstab_{a}_subscription")
    _write(st.rate_by(raw, "category", F.col("subscription_status") == "Yes", "subscribed_pct"),
           out, "rate_by_category")
    _write(st.kde(raw, "purchase_amount_usd", "subscription_status"), out, "amount_density")

    # segmentation
    z, seg_scaler = sg.segment_matrix(eng)
    zc = [f"z_{c}" for c in L.SEGMENT_FEATURES]
    feats = materialize(sg.assemble(z, zc))
    km = sg.kmeans_best(feats, k=5, seed=42, restarts=restarts)
    seg = sg.renumber_by(km.transform(feats), "raw_cluster", "total_spend_weighted_new")
    seg = materialize(seg)
    summary["silhouette"] = sg.silhouette(seg, zc, "cluster").first()["silhouette"]
    _write(sg.label_segments(sg.profile_segments(seg)), out, "segment_profile")
    _write(sg.crm_summary(seg), out, "crm_summary")
    _write(sg.label_segments(seg).select("customer_id", "cluster", "segment_name", "action"),
           out, "customer_segments")
    for k in (2, 3):
        proj, ratios = sg.project(seg, k)
        _write(proj.select("customer_id", "cluster", *[f"pc{i + 1}" for i in range(k)]), out,
               f"projection_{k}d")
        summary[f"pca_explained_{k}d"] = ratios
    centroids = sg.centroids_of(seg, zc, "cluster")

    # models
    md = mo.prepare_model_data(eng, prep_state=state)
    cv, best = mo.compare_cv(md, candidates)
    _write(cv, out, "cv_results")
    summary["best_model"] = best
    model, _ = mo.tune(md, best)
    scored = materialize(mo.score(model, md.test).select("customer_id", "label", "score"))
    sweep = ev.threshold_sweep(scored)
    _write(sweep, out, "threshold_sweep")
    thr = ev.best_threshold(sweep).first()["threshold"]
    summary["threshold"] = thr
    pred = scored.withColumn("pred", (F.col("score") >= thr).cast("int"))
    _write(ev.confusion(pred), out, "confusion")
    _write(ev.classification_report(pred), out, "classification_report")
    _write(ev.roc_curve(scored), out, "roc_curve")
    summary["auc"] = ev.roc_auc(scored).first()["auc"]
    names = [md.names[i] for i in md.keep]
    if hasattr(model, "coefficients"):
        _write(mo.top_coefficients(model, names), out, "top_coefficients")
    elif hasattr(model, "featureImportances"):
        _write(mo.top_importance(model, names), out, "top_importance")

    compared = materialize(mo.compare_models(md, candidates))
    _write(compared, out, "model_comparison")
    _write(ev.leaders(compared.withColumn("_pos", F.col("position"))), out, "model_leaders")

    bundle = ScoringBundle(model, names, md.scaler, thr, seg_scaler, centroids,
                           dict(L.SEGMENT_NAMES))
    save_scoring_state(os.path.join(out, "scoring_state"), md, bundle)
    return summary


def main(argv=None) -> None:
    from ..session import local_session
    from ..sources.io import read_customers
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    p.add_argument("--input", required=True)
    p.add_argument("--format", default="csv")
    p.add_argument("--out", required=True)
    a = p.parse_args(argv)
    spark = SparkSession.getActiveSession() or local_session()
    print(analyse(read_customers(spark, a.input, a.format), a.out))


if __name__ == "__main__":
    main()

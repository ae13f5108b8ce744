"""The whole workflow on the smallest tables, through a CSV file."""

import os

from conftest import SF_SMALL
from cartlens import catalog
from cartlens.plans.workflow import analyse
from cartlens.sources.io import read_customers


def test_analyse_end_to_end(spark, tmp_path):
    raw = catalog.shop(spark, SF_SMALL).toDF(*catalog.RAW_HEADERS)
    csv = str(tmp_path / "customers.csv")
    raw.write.option("header", True).csv(csv)
    out = str(tmp_path / "out")
    summary = analyse(read_customers(spark, csv, "csv"), out,
                      candidates=["LogisticRegression"], restarts=2)
    assert summary["dropped"] == ["discount_applied"] and summary["cramers_v"] > 0.8
    assert summary["best_model"] == "LogisticRegression"
    assert os.path.isdir(os.path.join(out, "scoring_state"))
    assert 0.0 < summary["auc"] <= 1.0 and -1.0 <= summary["silhouette"] <= 1.0
    for name in ["kpis", "value_counts", "segment_profile", "crm_summary", "cv_results",
                 "threshold_sweep", "classification_report", "roc_curve", "amount_density",
                 "customer_segments", "projection_2d", "projection_3d", "model_comparison",
                 "model_leaders"]:
        assert spark.read.parquet(os.path.join(out, name)).count() > 0, name
    assert spark.read.parquet(os.path.join(out, "threshold_sweep")).count() == 19

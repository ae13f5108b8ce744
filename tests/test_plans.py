"""Plan shape: no Python UDFs, no per-customer window, pushed-down scans."""

from conftest import SF_SMALL

import __spark_entry__ as entry
from cartlens import catalog, oracle
from cartlens.sources.shop import build_shop


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_shop_plan_has_no_window_and_prunes_columns(spark):
    plan = _plan(build_shop(spark, SF_SMALL))
    assert "Window" not in plan
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan
    # lineitem scan reads only the columns the shop needs
    assert "l_quantity" not in plan and "l_tax" not in plan


def test_no_python_udf_in_feature_plan(spark):
    plan = _plan(catalog.engineered(spark, SF_SMALL))
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns == ["category", "subscribed_pct"] and len(rows) > 0


def test_every_query_has_oracle_or_is_model_backed():
    q, o = catalog.queries(), oracle.oracle_sql()
    assert set(o) <= set(q) <= set(entry.queries())
    model_backed = {"kmeans_segments", "kmeans_silhouette", "cv_model_comparison", "pca_projection", "feature_selection", "cv_logistic",
                    "cv_forest_min_split",
                    "tuned_logistic_scores", "coefficients_top", "importance_top",
                    "model_comparison", "score_requests", "bundle_roundtrip", "score_trained"}
    assert set(q) - set(o) == model_backed

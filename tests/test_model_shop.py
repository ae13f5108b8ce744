"""The model queries of a session read one written ``shop``."""

import pytest
from pyspark.sql import functions as F

from cartlens import catalog
from cartlens.plans import model as mo
from cartlens.sources import shop as sh


@pytest.fixture
def built(spark, monkeypatch):
    """The folders for which ``shop`` was built, from 400 rows of our own."""
    i = F.col("customer_id")

    def pick(values, step):
        return F.element_at(F.array(*map(F.lit, values)), ((i * step) % len(values) + 1).cast("int"))

    rows = spark.range(1, 401).withColumnRenamed("id", "customer_id").select(
        i, (18 + i % 53).cast("double").alias("age"), pick(["Male", "Female"], 7).alias("gender"),
        pick(["hat", "shoe", "sock"], 5).alias("item_purchased"),
        pick(["A", "B"], 3).alias("category"), (i * 37 % 211 + 0.5).alias("purchase_amount_usd"),
        pick(["Maine", "Texas", "Ohio"], 11).alias("location"), pick(["S", "M"], 13).alias("size"),
        pick(["red", "blue"], 17).alias("color"), pick(sh.FIXTURE_SEASONS, 3).alias("season"),
        (2.5 + (i * 7 % 26) / 10).alias("review_rating"),
        F.when(i * 31 % 97 + i * 37 % 211 > 170, "Yes").otherwise("No").alias("subscription_status"),
        pick(["Express", "Standard"], 19).alias("shipping_type"),
        pick(["Yes", "No"], 23).alias("discount_applied"),
        pick(["Yes", "No", "No"], 29).alias("promo_code_used"),
        (i * 41 % 47).cast("double").alias("previous_purchases"),
        pick(sh.FIXTURE_PAYMENTS, 5).alias("payment_method"),
        pick(sh.FIXTURE_FREQUENCIES, 3).alias("frequency_of_purchases"))
    assert rows.columns == sh.SHOP_COLUMNS
    seen = []
    monkeypatch.setattr(catalog, "build_shop", lambda s, sf: seen.append(sf) or rows)
    monkeypatch.setattr(catalog, "_MODEL_DATA", {})
    select = mo.select_features
    monkeypatch.setattr(mo, "select_features", lambda train, names: select(train, names, trees=5))
    return seen


def test_model_queries_build_shop_once_per_folder(spark, built):
    scored = {q: catalog.QUERIES[q](spark, "a").collect()
              for q in ("score_trained", "score_requests", "bundle_roundtrip")}
    assert built == ["a"]
    for rows in scored.values():
        assert sorted(r.customer_id for r in rows) == list(range(1, 401))
    trained, loaded = ({r.customer_id: r.probability for r in scored[q]}
                       for q in ("score_trained", "bundle_roundtrip"))
    assert trained == loaded
    catalog.model_shop(spark, "b")
    assert built == ["a", "b"]


def test_written_shop_gives_the_rows_of_a_new_one(spark, built):
    new = catalog.engineered(spark, "a")
    kept = catalog.model_engineered(spark, "a")
    assert kept.schema == new.schema
    assert sorted(kept.collect()) == sorted(new.collect())

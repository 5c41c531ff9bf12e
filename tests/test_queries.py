"""Every registered query against its SQL on the smallest tables; models by their invariants."""

from __future__ import annotations

import pytest

from prefloom import registry

from .oracle import same


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0
    assert set(registry.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, small, name):
    same(spark, name, registry.QUERIES[name], registry.SQL[name], small)


@pytest.mark.parametrize("name", ["als_implicit", "l1_logistic"])
def test_model_rows(spark, small, name):
    assert registry.QUERIES[name](spark, small).count() > 0


def test_all_interactions(spark, small):
    """Each pair has a product of each of its user's and its item's features."""
    from prefloom.plans import features as pf

    pairs = pf.order_events(spark, small).select("user_id", "item_id").distinct()
    each = pairs.join(pf.user_features(spark, small).groupBy("user_id").count().withColumnRenamed("count", "u"), "user_id").join(pf.item_features(spark, small).groupBy("item_id").count().withColumnRenamed("count", "i"), "item_id")
    want = each.selectExpr("sum(u * i)").first()[0]
    assert registry.QUERIES["user_item_interactions_all"](spark, small).count() == want > registry.QUERIES["user_item_interactions"](spark, small).count()
    names = registry.QUERIES["interaction_names_all"](spark, small)
    assert names.selectExpr("sum(n)").first()[0] == want and names.where("right_name = 'i_price' and left_name like 'u_age%'").count() > 0


def test_numbers_of_negatives(spark, small, monkeypatch):
    """All five other categories of the test tables for a purchase, and ten draws for a rating of the model."""
    n = registry.QUERIES["negative_categories_random_20"](spark, small).groupBy("user_id", "ts", "category").count()
    assert {r["count"] for r in n.select("count").distinct().collect()} == {5}
    from prefloom.plans import models

    real, drawn = models.f.labelled_pairs, []

    def pairs(*args):
        drawn.append(real(*args))
        raise InterruptedError

    monkeypatch.setattr(models.f, "labelled_pairs", pairs)
    with pytest.raises(InterruptedError):
        registry.QUERIES["l1_logistic"](spark, small)
    labels = {r.label: r["count"] for r in drawn[0].groupBy("label").count().collect()}
    assert 9 * labels[1] < labels[0] <= 10 * labels[1]

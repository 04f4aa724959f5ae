import pytest

from faircart.operators import normalize
from faircart.plans import catalogue

SHELF_QUERIES = (
    "pointer_selections", "card_candidates", "discovery_prompts", "extraction_prompts", "observation_prune", "pointer_resolution", "preannotation", "sibling_completion",
    "observation_crop", "training_examples", "markup_titles", "card_roots",
)


@pytest.mark.parametrize("name", SHELF_QUERIES)
def test_nodes_are_not_broadcast(spark, sf_dir, monkeypatch, name):
    # Nodes of a file of a few MB are millions of rows; with FEW at zero texts count as many, too.
    monkeypatch.setattr(normalize, "FEW", 0)
    plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    assert "BroadcastExchange" not in plan


def test_many_distinct_keys_are_not_broadcast(spark, monkeypatch):
    rows = spark.range(50).selectExpr("cast(id % 7 as string) as text")
    add = lambda d: d.selectExpr("text", "length(text) as n")
    monkeypatch.setattr(normalize, "FEW", 6)
    many = normalize.per_distinct(rows, ["text"], add)
    assert "SortMergeJoin" in many._jdf.queryExecution().executedPlan().toString()
    assert many.where("n = 1").count() == 50

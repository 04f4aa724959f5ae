"""Costly rules run once for each text, once for each row, and on all cores."""

import pytest
from pyspark.sql import functions as F

from faircart.functions import grammar, shape
from faircart.operators import normalize, reviews
from faircart.plans import catalogue


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ("pack_count_parse", "native_price_parse", "price_audit"))
def test_rules_over_texts_run_before_the_rows(spark, sf_dir, name):
    plan = plan_of(catalogue.QUERIES[name](spark, sf_dir)).lower()
    assert "rlike" not in plan
    # Displays of an audit are still made for each row.
    assert name == "price_audit" or "regexp" not in plan
    assert "strategy=broadcast" in plan


def test_long_keys_are_not_forced_into_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(normalize, "SHORT", 5)
    rows = spark.range(9).selectExpr("concat('text ', id % 3) as text")
    found = normalize.per_distinct(rows, ["text"], lambda d: d.selectExpr("text", "length(text) as n"))
    assert "strategy=broadcast" not in plan_of(found)
    assert found.where("n = 6").count() == 9


@pytest.mark.parametrize("name", ("collected_cards", "answer_shapes"))
def test_a_file_of_one_split_goes_over_all_cores(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).rdd.getNumPartitions() >= 4


@pytest.mark.parametrize("name", ("campaign_problems", "campaign_entries"))
def test_submissions_are_read_once(spark, sf_dir, name):
    assert plan_of(catalogue.QUERIES[name](spark, sf_dir)).count("from_json(") == 1


def test_odd_submissions(spark):
    queue = spark.range(1, 4).select(
        F.concat(F.lit("eve--"), "id").alias("review_id"), F.col("id").alias("page_id"), F.lit("eve").alias("reviewer"), F.lit("s").alias("source"), F.array(F.lit("a")).alias("source_reviews"), F.array(F.lit("n1")).alias("cards")
    )
    given = [
        ("a", '{"review_id": "eve--1", "page_id": 1.0}'), ("b", '{"review_id": "eve--1"}'), ("c", "{oops"), ("d", "[1]"), ("e", None), ("f", '{"review_id": "other"} {}'), ("g", ' {"review_id": "other"}'),
        ("h", '{"review_id": 12.50}'),
    ]
    problems = reviews.compile_campaign(queue, spark.createDataFrame(given, "file string, content string"))[1]
    assert sorted(map(tuple, problems.collect()), key=str) == sorted(
        [
            ("a", "eve--1", "contract-changed"), ("b", "eve--1", "duplicate"), ("c", None, "not-json"), ("d", None, "no-review-id"), ("e", None, "not-json"), ("f", None, "not-json"), ("g", "other", "unexpected"),
            ("h", "12.5", "unexpected"), (None, "eve--1", "missing"), (None, "eve--2", "missing"), (None, "eve--3", "missing"),
        ],
        key=str,
    )


def test_a_pointer_is_split_once(spark):
    assert plan_of(spark.range(1).select(grammar.pointer_fields(F.col("id").cast("string")).alias("x"))).count("split(") == 1


def test_shapes_parse_a_document_once(spark):
    plan = plan_of(spark.createDataFrame([("[]",)], "d string").select(shape.faults(F.col("d"), shape.page_extraction())))
    assert plan.count("parse_json(") == 1


def test_pages_are_read_by_all_cores(spark, sf_dir):
    from faircart.plans import tree_plans

    assert tree_plans.nodes_of(spark, sf_dir).rdd.getNumPartitions() >= 4

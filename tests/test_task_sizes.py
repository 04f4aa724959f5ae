"""What one task sorts or groups stays the same however large the tables are."""

import pytest

from faircart.functions.text import squeezed_alnum, squeezed_similarity, text_similarity, word_set
from faircart.operators import evaluation
from faircart.plans import catalogue, evaluation_plans, shelves


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ("observation_crop", "card_roots", "markup_titles"))
def test_tasks_grow_with_shelves(spark, sf_dir, monkeypatch, name):
    monkeypatch.setattr(shelves, "TASK_PARTS", 10)  # 200 parts
    assert ", 20), REPARTITION_BY_NUM" in plan_of(catalogue.QUERIES[name](spark, sf_dir))


def test_tasks_grow_with_lines(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(evaluation_plans, "TASK_LINES", 500)
    plan = plan_of(catalogue.QUERIES["range_chunks"](spark, sf_dir))
    assert "REPARTITION_BY_NUM" in plan and plan.count("Exchange") == 1


def test_boxes_of_small_pages_are_shuffled_by_page_alone(spark, sf_dir):
    plan = plan_of(catalogue.QUERIES["iou_join"](spark, sf_dir))
    assert "Union" in plan and "Generate" not in plan.split("Union")[1].split("\n   :")[0]


def test_small_and_crowded_pages_agree(spark, sf_dir, monkeypatch):
    b = evaluation_plans.boxes_of(spark, sf_dir).selectExpr("page % 3 as page", "n", "l_partkey", "x", "y", "w", "h").where("page < 50").limit(90)
    nodes = b.selectExpr("page", "concat(n, '-', l_partkey, '-', x) as node_id", "n % 3 as depth", "n % 2 = 0 as listed", "x + 15 as x", "y + 5 as y", "w", "h")
    more = spark.createDataFrame([(0, "gone", 0, True, None, 1.0, 9.0, 9.0)], "page long, node_id string, depth int, listed boolean, x double, y double, w double, h double")
    found = []
    for most in (0, 20, 10_000):
        monkeypatch.setattr(evaluation, "CROWD", most)
        found.append(sorted(map(str, evaluation.best_box(b, nodes.unionByName(more), "page", tasks=3).collect())))
    assert found[0] == found[1] == found[2] and found[0]


def test_similarity_of_texts_squeezed_before(spark):
    d = spark.createDataFrame([("Blue Ring", "blue  ring, 5 oz"), ("a b", "b c"), ("", "x"), ("!", "?"), ("É", "e"), (None, "a")], "l string, r string")
    a, b = squeezed_alnum(d.l), squeezed_alnum(d.r)
    assert all(r[0] == r[1] for r in d.select(text_similarity(d.l, d.r), squeezed_similarity(a, word_set(a), b, word_set(b))).collect())

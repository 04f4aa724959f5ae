"""Candidates, answers, annotations, shapes, campaigns and orders on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from faircart.functions import shape
from faircart.operators import evaluation, evidence, reviews, selection
from faircart.sources import files
from faircart.streaming import sessions

NODE = "page_id long, node int, path array<int>, tag string, text string, label string"


def card(page, *texts):
    """A card of one node per ``(tag, text)`` below node 0."""
    return [(page, 0, [0], "div", None, None)] + [(page, i, [0, i], tag, text, None) for i, (tag, text) in enumerate(texts, 1)]


def annotated(spark, rows, dimension=None):
    nodes = spark.createDataFrame(rows, NODE)
    cards = nodes.where("node = 0").select("page_id", F.lit(0).alias("card"), F.lit(dimension).cast("string").alias("dimension"))
    return {r.page_id: r for r in evidence.annotate(nodes, cards).collect()}


def test_annotations(spark):
    rows = (
        card(1, ("h3", "Oats, 2 x 12 oz"), ("span", "$4.80"), ("span", "was $6.00"))
        + card(2, ("a", "Rolled Oats, 24 oz"), ("span", "$4.80"), ("span", "20¢/oz"))
        + card(3, ("a", "Rolled Oats"), ("span", "$4.80"))
        + card(4, ("a", "Rolled Oats, 24 oz"), ("span", "save $1.00"))
        + card(5, ("span", "$4.80"), ("span", "12 oz"))
        + card(6, ("a", "Batteries 4 ct"), ("span", "$1.00 / ea"), ("span", "$4.00"))
        + card(7, ("a", "Rolled Oats, 24 oz"), ("span", "$4.80"), ("span", "$9.99"))
        + [(8, 0, [0], "div", None, None)]
    )
    got = annotated(spark, rows)
    one = got[1]
    assert (one.method, one.title_node, one.price.cents, one.quantity.value, one.quantity.packs) == ("price-and-package", 1, 480, 12.0, 2)
    assert (got[2].method, got[2].native.cents, got[2].native.evidence, got[2].price.cents) == ("native-unit-price", 20.0, [3], 480)
    assert (got[3].method, got[3].abstain_reason) == ("explicit-abstention", "ambiguous-quantity")
    assert got[4].abstain_reason == "conditional-price"
    assert (got[5].abstain_reason, got[5].title) == ("not-a-product", "$4.80")
    assert got[6].native is None
    assert got[7].abstain_reason == "insufficient-evidence"
    assert 8 not in got
    assert all(r.issues == [] for r in got.values())


def test_a_rate_split_over_two_nodes(spark):
    apart = [(1, 0, [0], "div", None, None), (1, 1, [0, 1], "a", "Oak Floor", None), (1, 2, [0, 2], "b", "per sq ft", None), (1, 3, [0, 3], "i", "$3.49", None)]
    got = annotated(spark, apart, "area")[1]
    assert (got.method, got.native.cents, got.native.unit, got.native.evidence, got.issues) == ("native-unit-price", 349.0, "sq_ft", [3, 2], [])
    assert annotated(spark, apart)[1].native is None
    assert annotated(spark, [*apart, (1, 4, [0, 4], "i", "$9.00", None)], "area")[1].native is None
    nodes = spark.createDataFrame(apart, NODE)
    ids = {r.id: r for r in evidence.candidates(nodes, nodes.where("node = 0").selectExpr("page_id", "node as card")).collect()}
    assert sorted(ids) == ["n0@p0", "n0@u0", "n3@p0"]
    assert (ids["n0@u0"].evidence, ids["n0@u0"].cents, ids["n0@u0"].source) == ([3, 2], 349.0, "$3.49 per sq ft")


def answer(card="n0", title="n1", price="NONE", native="NONE", quantity="NONE", pack="NONE", status="comparable"):
    return f"CARD {card}\nTITLE {title}\nCURRENT_PRICE {price}\nNATIVE_UNIT_PRICE {native}\nPACKAGE_QUANTITY {quantity}\nPACK_COUNT {pack}\nSTATUS {status}"


def test_answers_resolve_or_say_why_not(spark):
    rows = card(1, ("a", "Oats, pack of 3"), ("b", "12 oz"), ("span", "$4.80")) + [(1, 9, [9], "p", "$7.00", None), (1, 10, [0, 10], "p", None, None)]
    nodes = spark.createDataFrame(rows, NODE)
    cases = {
        answer(price="n3@p0", quantity="n2@q0", pack="n1@k0"): ("comparable", []),
        answer(price="n9@p0", quantity="n2@q0"): ("invalid", ["CURRENT_PRICE:evidence-outside-card"]),
        answer(price="n3@p1", quantity="n2@q7"): ("invalid", ["CURRENT_PRICE:unknown-candidate", "PACKAGE_QUANTITY:unknown-candidate"]),
        answer(native="n3@p0"): ("invalid", ["NATIVE_UNIT_PRICE:candidate-kind-mismatch"]),
        answer(card="n77", status="price-range"): ("invalid", ["CARD:unknown-node"]),
        answer(title="n1,n9,n50", price="n3@p9", quantity="n2@q0"): ("invalid", ["TITLE:evidence-outside-card", "TITLE:unknown-node"]),
        answer(title="n10", status="price-range"): ("invalid", ["TITLE:missing-evidence"]),
        answer(title="n3,n1", status="price-range"): ("abstained", []),
        "nonsense": ("invalid", ["OUTPUT:invalid-line-count"]),
        None: ("invalid", ["OUTPUT:invalid-output-type"]),
    }
    asked = spark.createDataFrame(list(enumerate(cases)), "answer_id long, answer string").withColumn("page_id", F.lit(1).cast("long"))
    got = {r.answer_id: r for r in evidence.resolve_pointers(asked, nodes).collect()}
    assert [(got[i].state, got[i].issues) for i in range(len(cases))] == list(cases.values())
    first = got[0]
    assert (first.title, first.cents, first.quantity.value, first.packs) == ("Oats, pack of 3", 480, 12.0, 3)
    assert got[7].title == "$4.80 Oats, pack of 3"


@pytest.mark.parametrize(
    "document, want",
    [
        (None, ["$:not-json"]),
        ("[1]", ["$:not-an-object"]),
        ('{"version": 1, "pageId": "", "products": []}', []),
        ('{"version": 1.0, "pageId": null, "products": [3]}', ["$.pageId:not-a-text", "$.products[0]:not-an-object"]),
        ('{"version": "1", "pageId": "p"}', ["$.products:missing", "$.version:not-allowed"]),
        ('{"version": 1, "pageId": "p", "products": [{"cardNodeId": "", "title": {"value": " ", "evidenceNodeIds": ["a", ""]}, "currentPrice": null}]}',
         ["$.products[0].cardNodeId:not-a-text", "$.products[0].currentPrice:not-an-object", "$.products[0].title.evidenceNodeIds[1]:not-a-text", "$.products[0].title.value:not-a-text"]),
    ],
)
def test_shapes(spark, document, want):
    rows = spark.createDataFrame([(document,)], "d string").select(shape.faults(F.col("d"), shape.page_extraction()).alias("f"))
    assert sorted(rows.first().f) == want


def test_alternating_by_rounds(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("abbbcd"), rng.random() < 0.3) for i in rng.sample(range(10_000), 300)] + [(-1, "e", True)]
    want, sites = [], sorted({r[1] for r in rows})
    left = {s: {k: sorted(r[0] for r in rows if r[1] == s and r[2] == k) for k in (False, True)} for s in sites}
    turn = 0
    while any(x for s in left.values() for x in s.values()):
        for i, s in enumerate(sites):
            first = (i + turn) % 2 == 1
            for kind in (first, not first):
                if left[s][kind]:
                    want.append(left[s][kind].pop(0))
                    break
        turn += 1
    got = selection.alternating(spark.createDataFrame(rows, "id long, site string, late boolean"), "site", "late", ["id"])
    assert [r.id for r in got.orderBy("turn").collect()] == want
    assert got.agg(F.max("turn"), F.count_distinct("turn")).first()[:] == (301, 301)


def test_contained_labels(spark):
    labels = [(1, "Oat"), (1, "x"), (1, "big  OATS box!"), (1, "none"), (2, "oat"), (1, ""), (1, None)]
    texts = [(1, "rolled oats"), (1, "oats"), (1, "Oats box"), (1, " "), (1, None), (3, "oat")]
    got = evaluation.contained_labels(spark.createDataFrame(labels, "p long, label string"), spark.createDataFrame(texts, "p long, text string"), ["p"])
    assert sorted(tuple(r) for r in got.collect()) == [(1, "Oat", "oats", "contains"), (1, "big  OATS box!", "oats", "contained"), (1, "x", "Oats box", "contains")]


def test_review_issues(spark):
    good = "\n".join(["CARD n1", "TITLE n1", "CURRENT_PRICE NONE", "NATIVE_UNIT_PRICE n1@u0", "PACKAGE_QUANTITY NONE", "PACK_COUNT NONE", "STATUS comparable"])
    gone = good.replace("n1@u0", "NONE").replace("STATUS comparable", "STATUS not-a-product")
    products = [("n1", "product", good), ("n1", "product", good), ("n2", "product", good), ("n3", "non-product", good.replace("CARD n1", "CARD n3")), ("n4", "product", gone.replace("CARD n1", "CARD n4")), ("n5", "product", "?")]
    review = (" ", 1, None, "adjudicated", "yesterday", "partly", "shown-after-submit", "s", ["a", "a"], products)
    rows = spark.createDataFrame([(review, ["n1", "n2", "n9"])], f"r {reviews.REVIEW}, cards array<string>")
    got = rows.select(reviews.review_issues(F.col("r"), F.col("cards")).alias("i")).first().i
    assert got == [
        "no-review-id", "no-reviewer", "no-time", "incomplete", "sources-of-two", "n1:duplicate-card", "n2:other-card", "n3:scope-needs-status", "n4:status-needs-scope",
        "n5:invalid-target", "n9:omitted", "n3:unexpected", "n4:unexpected", "n5:unexpected",
    ]


def test_pictures(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.png").write_bytes(b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big") + b"rest")
    (tmp_path / "a" / "bad.png").write_bytes(b"\x89PNG")
    (tmp_path / "a" / "note.txt").write_bytes(b"x")
    got = files.read_pictures(spark, str(tmp_path)).withColumn("ok", files.fits_region(F.col("size"), F.lit(642), F.lit(478)))
    assert sorted((r.name, r.size and r.size.width, r.ok) for r in got.collect()) == [("bad.png", None, False), ("one.png", 640, True)]


def test_newest_as_a_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    source = str(tmp_path / "in")
    events.repartition(4).write.parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = sessions.newest(stream, "user_id", "ts", "event_id").writeStream.format("memory").queryName("newest").outputMode("update").trigger(availableNow=True)
    out.option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    want = {tuple(r) for r in sessions.newest(events, "user_id", "ts", "event_id").collect()}
    changes = spark.table("newest")
    assert {tuple(r) for r in sessions.newest(changes, "user_id", "ts", "event_id").collect()} == want
    assert changes.count() < events.count()

"""Queries over answers' shapes, review campaigns, pictures, balanced orders and contained labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import grammar, shape
from ..operators import evaluation, experiments, reviews, selection
from ..sources import files
from ..streaming import sessions
from .common import SQL_MACROS, cents_of, dealt, registry, table

QUERIES, ORACLE_SQL, query = registry()

SHAPE_FAULTS = (
    "", "$.note:unknown-key", "$.products[0].title.lang:unknown-key", "$.version:not-allowed", "$.products[0].currentPrice.currency:not-allowed", "$.products[0].currentPrice.cents:not-a-number",
    "$.products[0].title.evidenceNodeIds:too-few", "$.products[0].title.evidenceNodeIds:repeated", "$.products[0].title:missing", "$:not-json", "$.products[1].abstainReason:not-allowed,$.products[1].x:unknown-key", "$.products:not-an-array",
)


@query("answer_shapes", "SELECT p_partkey, [" + ", ".join(f"'{f}'" for f in SHAPE_FAULTS) + "][p_partkey % 12 + 1] AS faults FROM part")
def answer_shapes(spark, sf_dir):
    """Extractions as JSON, most with one thing that their closed shape doesn't allow, at some depth."""
    v = F.col("p_partkey") % 12
    pick = lambda k, one, other: F.when(v == k, F.lit(one) if isinstance(one, str) else one).otherwise(F.lit(other) if isinstance(other, str) else other)
    cited = F.when(v == 6, "[]").when(v == 7, '["n2", "n2"]').otherwise('["n2"]')
    title = F.concat(F.lit('"title": {"value": "'), "p_name", F.lit('", '), pick(2, '"lang": "en", ', ""), F.lit('"evidenceNodeIds": '), cited, F.lit("}, "))
    cents = cents_of(F.col("p_retailprice")).cast("string")
    price = F.concat(F.lit('"currentPrice": {"cents": '), pick(5, F.concat(F.lit('"'), cents, F.lit('"')), cents), F.lit(', "currency": "'), pick(4, "EUR", "USD"), F.lit('", "evidenceNodeIds": ["n3"]}'))
    first = F.concat(F.lit('{"cardNodeId": "n1", '), pick(8, "", title), price, F.lit("}"))
    second = pick(10, ', {"cardNodeId": "n5", "title": {"value": "x", "evidenceNodeIds": ["n6"]}, "abstainReason": "bored", "x": {"y": 1}}', "")
    products = pick(11, '{"0": 1}', F.concat(F.lit("["), first, second, F.lit("]")))
    whole = F.concat(F.lit('{"version": '), pick(3, "2", "1"), pick(1, ', "note": []', ""), F.lit(', "pageId": "p", "products": '), products, pick(9, "", "}"))
    found = F.array_join(F.array_sort(shape.faults(whole, shape.page_extraction())), ",")
    return dealt(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", found.alias("faults"))


def page_reviews(spark, sf_dir, who: str, abstains):
    """A review of every order as a page of three cards, by one reviewer."""
    o = dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    none = {k: F.lit(None).cast("string") for k in grammar.KINDS}

    def product(i):
        card, out = F.lit(f"n{i}"), abstains(F.col("o_custkey") + i)
        values = none | {"NATIVE_UNIT_PRICE": F.when(~out, F.lit(f"n{i}@u0"))}
        target = grammar.serialize_pointer(card, F.array(card), values, F.when(out, "price-range").otherwise("comparable"))
        return F.struct(card.alias("card"), F.lit("product").alias("scope"), target.alias("target"))

    review = F.struct(
        F.concat(F.lit(who + "--"), "o_orderkey").alias("review_id"), F.col("o_orderkey").alias("page_id"), F.lit(who).alias("reviewer"), F.lit("independent").alias("phase"),
        F.lit("2024-05-01T10:00:00Z").alias("completed"), F.lit("complete-main-region").alias("coverage"), F.lit("hidden").alias("visibility"), F.md5(F.col("o_orderkey").cast("string").cast("binary")).alias("source"),
        F.array().cast("array<string>").alias("source_reviews"), F.array(*map(product, (1, 2, 3))).alias("products"),
    )
    return o.select(F.col("o_orderkey").alias("page_id"), review.alias("review"))


def both_reviews(spark, sf_dir):
    return page_reviews(spark, sf_dir, "ann", lambda k: k < 0), page_reviews(spark, sf_dir, "bob", lambda k: k % 3 == 0)


@query(
    "adjudication_queue",
    """SELECT o_orderkey AS page_id, concat('eve--', o_orderkey) AS review_id, md5(o_orderkey::VARCHAR) AS source, 3 AS aligned, 2 AS same, 0 AS issues,
      CASE WHEN o_orderkey % 5 = 0 THEN 'gone' WHEN o_orderkey % 7 = 0 THEN 'changed' END AS drift FROM orders""",
)
def adjudication_queue(spark, sf_dir):
    """What a third reviewer gets to decide, and which pages have drifted since."""
    a, b = both_reviews(spark, sf_dir)
    queue = reviews.adjudication_queue(a, b, "eve")
    later = b.where("page_id % 5 <> 0").withColumn("review", F.when(F.col("page_id") % 7 == 0, F.col("review").withField("completed", F.lit("2024-06-01T10:00:00Z"))).otherwise(F.col("review")))
    drift = reviews.drifted(queue, a, later, "eve")
    return queue.join(drift, "page_id", "left").select("page_id", "review_id", "source", "agreement.aligned", "agreement.same", F.size("issues").alias("issues"), "drift")


def campaign(spark, sf_dir):
    """The queue of all orders and what was submitted: right ones, and wrong in one way by key."""
    a, b = both_reviews(spark, sf_dir)
    queue = reviews.adjudication_queue(a, b, "eve")
    v, i = F.col("page_id") % 10, F.col("page_id").cast("string")
    products = F.when(v == 7, F.slice("p", 1, 2)).when(v == 8, F.transform("p", lambda x: F.when(x["card"] == "n2", x.withField("target", F.lit("CARD n2"))).otherwise(x))).otherwise(F.col("p"))
    rows = queue.join(a.select("page_id", F.col("review.products").alias("p")), "page_id")
    review = F.struct(
        F.when(v == 3, " ").when(v == 5, F.concat(F.lit("stray-"), i)).otherwise(F.col("review_id")).alias("review_id"), "page_id", "reviewer", F.lit("adjudicated").alias("phase"), F.lit("2024-05-02T10:00:00+02:00").alias("completed"),
        F.lit("complete-main-region").alias("coverage"), F.lit("shown-after-submit").alias("visibility"), F.when(v == 6, "other").otherwise(F.col("source")).alias("source"),
        F.reverse("source_reviews").alias("source_reviews"), products.alias("products"),
    )
    content = F.when(v == 2, "{oops").otherwise(F.to_json(review))
    files = F.when(v == 4, F.array(F.concat(F.lit("a-"), i), F.concat(F.lit("b-"), i))).otherwise(F.array(F.concat(F.lit("a-"), i)))
    given = rows.where(v != 9).select(content.alias("content"), F.explode(files).alias("file"))
    return reviews.compile_campaign(queue, given)


@query(
    "campaign_problems",
    """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 10 AS v FROM orders)
    SELECT 'a-' || k AS file, CASE WHEN v IN (2, 3) THEN NULL WHEN v = 5 THEN 'stray-' || k ELSE 'eve--' || k END AS review_id,
      CASE v WHEN 2 THEN 'not-json' WHEN 3 THEN 'no-review-id' WHEN 5 THEN 'unexpected' WHEN 6 THEN 'contract-changed' WHEN 7 THEN 'n3:omitted' WHEN 8 THEN 'n2:invalid-target' END AS issue FROM o WHERE v IN (2, 3, 5, 6, 7, 8)
    UNION ALL SELECT 'b-' || k, 'eve--' || k, 'duplicate' FROM o WHERE v = 4 UNION ALL SELECT NULL, 'eve--' || k, 'missing' FROM o WHERE v IN (2, 3, 5, 6, 7, 8, 9)""",
)
def campaign_problems(spark, sf_dir):
    """Why submissions were put aside, and which reviews are missing."""
    return campaign(spark, sf_dir)[1]


@query(
    "campaign_entries",
    """SELECT 'eve--' || o_orderkey AS review_id, o_orderkey AS page_id, 'n' || i AS card, 'comparable' AS status FROM orders, range(1, 4) t(i) WHERE o_orderkey % 10 IN (0, 1, 4)""",
)
def campaign_entries(spark, sf_dir):
    """The products of all submissions that are right."""
    return campaign(spark, sf_dir)[0].select("review_id", "page_id", "card", "status")


@query(
    "picture_sizes",
    """SELECT p_partkey, CASE WHEN p_partkey % 11 > 0 THEN p_size * 10 + p_partkey % 5 END::BIGINT AS width, p_partkey % 11 > 0 AND p_partkey % 5 <= 2 AS fits FROM part""",
)
def picture_sizes(spark, sf_dir):
    """Pictures whose header gives the size of the region that they show, within two pixels."""
    wide, high = F.col("p_size") * 10 + F.col("p_partkey") % 5, F.col("p_size") * 7
    number = lambda n: F.lpad(F.hex(n.cast("long")), 8, "0")
    mark = F.when(F.col("p_partkey") % 11 == 0, "89504E470D0A1A0B").otherwise("89504E470D0A1A0A")
    content = F.unhex(F.concat(mark, F.lit("0000000D49484452"), number(wide), number(high), F.lit("0802000000")))
    size = files.png_size(content)
    return table(spark, sf_dir, "part").select("p_partkey", size["width"].alias("width"), files.fits_region(size, F.col("p_size") * 10, high).alias("fits"))


@query(
    "domain_balanced",
    """WITH r AS (SELECT o_orderkey, o_custkey % 7 AS site, o_custkey % 3 = 0 AS late FROM orders),
    k AS (SELECT *, row_number() OVER (PARTITION BY site, late ORDER BY o_orderkey) - 1 AS k, count(*) FILTER (WHERE late) OVER (PARTITION BY site) AS lates, count(*) FILTER (WHERE NOT late) OVER (PARTITION BY site) AS others, dense_rank() OVER (ORDER BY site) - 1 AS place FROM r),
    t AS (SELECT *, CASE WHEN late = (place % 2 = 1) THEN CASE WHEN k <= other THEN 2 * k ELSE other + k END ELSE CASE WHEN k < other THEN 2 * k + 1 ELSE other + k END END AS round FROM (SELECT *, CASE WHEN late THEN others ELSE lates END AS other FROM k))
    SELECT o_orderkey, row_number() OVER (ORDER BY round, place) AS turn FROM t""",
)
def domain_balanced(spark, sf_dir):
    """Records by turns over sites, by turns one that abstains and one that doesn't."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 7).alias("site"), (F.col("o_custkey") % 3 == 0).alias("late"))
    return selection.alternating(rows, "site", "late", ["o_orderkey"]).select("o_orderkey", "turn")


@query(
    "label_containment",
    """WITH t AS (SELECT DISTINCT p_brand, p_name || ' ' || p_type AS text FROM part),
    l AS (SELECT DISTINCT p_brand, unnest([upper(p_name), 'the ' || lower(p_name) || '  ' || p_type || ' set', p_type, left(p_name, 2), p_name || ' ' || p_type]) AS label FROM part),
    n AS (SELECT p_brand, label, text, lower(trim(regexp_replace(label, '\\s+', ' ', 'g'))) AS a, lower(text) AS b FROM l JOIN t USING (p_brand)),
    r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, label ORDER BY length(text), text) AS r FROM n WHERE contains(a, b) OR contains(b, a))
    SELECT p_brand, label, text, CASE WHEN a = b THEN 'equal' WHEN contains(b, a) THEN 'contains' ELSE 'contained' END AS relation FROM r WHERE r = 1""",
)
def label_containment(spark, sf_dir):
    """F8: the shortest text of a brand that a label equals, stands in or holds."""
    p = table(spark, sf_dir, "part")
    labels = F.array(F.upper("p_name"), F.concat(F.lit("the "), F.lower("p_name"), F.lit("  "), "p_type", F.lit(" set")), "p_type", F.substring("p_name", 1, 2), F.concat_ws(" ", "p_name", "p_type"))
    texts = p.select("p_brand", F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return evaluation.contained_labels(p.select("p_brand", F.explode(labels).alias("label")), texts, ["p_brand"])


@query(
    "status_groups",
    """WITH g AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
    SELECT user_id, CAST(sum(n) AS BIGINT) AS products, count(*) AS groups, count_if(n >= 3) AS sortable_groups FROM g GROUP BY user_id""",
)
def status_groups(spark, sf_dir):
    """K3: the running state of each page with its groups, exactly."""
    return sessions.status_counts(table(spark, sf_dir, "events"), "user_id", "event_type", 3).select("user_id", "products", "groups", "sortable_groups")


@query(
    "adjudication_checks",
    """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 9 AS v FROM orders)
    SELECT k AS page_id, CASE v WHEN 1 THEN 'not-adjudicated' WHEN 2 THEN 'same-person' WHEN 3 THEN 'not-later' WHEN 4 THEN 'other-sources' WHEN 5 THEN 'n3:omitted' WHEN 6 THEN 'n9:other-card,n9:unreviewed,n3:omitted'
      WHEN 7 THEN 'n3:disputed-root' ELSE '' END AS issues FROM o""",
)
def adjudication_checks(spark, sf_dir):
    """Final reviews against the two that they decide."""
    a, b = both_reviews(spark, sf_dir)
    v = F.col("page_id") % 9
    rows = a.withColumnRenamed("review", "a").join(b.withColumnRenamed("review", "b"), "page_id")
    rows = rows.withColumn("b", F.when(v == 7, F.col("b").withField("products", F.slice("b.products", 1, 2))).otherwise(F.col("b")))
    renamed = F.transform("a.products", lambda p: F.when(p["card"] == "n3", p.withField("card", F.lit("n9"))).otherwise(p))
    products = F.when(v == 5, F.slice("a.products", 1, 2)).when(v == 6, renamed).otherwise(F.col("a.products"))
    done = F.when(v == 3, F.lit("2024-05-01T12:00:00+02:00")).otherwise(F.lit("2024-05-01T10:00:01Z"))
    sources = F.when(v == 4, F.array("a.review_id")).otherwise(F.array("b.review_id", "a.review_id"))
    third = F.struct(
        F.lit("x").alias("review_id"), "page_id", F.when(v == 2, "bob").otherwise("eve").alias("reviewer"), F.when(v == 1, "independent").otherwise("adjudicated").alias("phase"), done.alias("completed"),
        sources.alias("source_reviews"), products.alias("products"),
    )
    rows = rows.withColumn("third", third)
    issues = reviews.adjudication_issues(F.col("third"), F.col("a"), F.col("b"))
    # Omitted comes before unreviewed in the operator; here the order of the text is fixed.
    order = lambda x: F.array_sort(x, lambda p, q: F.when(F.endswith(p, F.lit("omitted")), 1).otherwise(0) - F.when(F.endswith(q, F.lit("omitted")), 1).otherwise(0))
    return rows.select("page_id", F.array_join(order(issues), ",").alias("issues"))


@query(
    "campaign_provenance",
    """WITH p AS (SELECT o_orderkey AS page_id, o_custkey % 3 AS campaign, o_orderkey % 7 AS cards, o_orderstatus AS status, md5(o_orderkey::VARCHAR) AS hash FROM orders)
    SELECT page_id, campaign, CASE WHEN page_id % 4 > 0 AND page_id % 13 > 0 THEN 'eligible' WHEN page_id % 4 = 0 THEN 'retired' END AS origin,
      concat_ws(',', CASE WHEN page_id % 5 = 0 THEN 'repeated-page' END, CASE WHEN cards = 0 THEN 'no-cards' END, CASE WHEN page_id % 4 > 0 AND page_id % 13 = 0 THEN 'unknown-evidence' END) AS issues
    FROM p CROSS JOIN range(1, 3) t(i) WHERE i = 1 OR page_id % 5 = 0""",
)
def campaign_provenance(spark, sf_dir):
    """Pages of campaigns against the registries of eligible and retired captures."""
    p = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("page_id"), (F.col("o_custkey") % 3).alias("campaign"), (F.col("o_orderkey") % 7).alias("cards"), F.col("o_orderstatus").alias("status"), F.md5(F.col("o_orderkey").cast("string").cast("binary")).alias("hash")
    )
    eligible = p.where("page_id % 4 <> 0").withColumn("hash", F.when(F.col("page_id") % 13 == 0, "changed").otherwise(F.col("hash")))
    found = reviews.campaign_provenance(p.unionByName(p.where("page_id % 5 = 0")), eligible, p.where("page_id % 4 = 0"), ["status", "hash"])
    return found.select("page_id", "campaign", "origin", F.array_join("issues", ",").alias("issues"))


@query(
    "card_pack_counts",
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 6 WHEN 1 THEN p_size + 1 WHEN 2 THEN NULL WHEN 3 THEN 3 ELSE 4 END AS packs FROM part""",
)
def card_pack_counts(spark, sf_dir):
    """Packs by title, by the chosen control, by none of them, or by the text."""
    from ..functions import prices

    v = F.col("p_partkey") % 5
    title = F.when(v == 0, F.concat("p_name", F.lit(", pack of 6"))).otherwise(F.col("p_name"))
    text = F.concat("p_name", F.when(v == 4, F.lit(" 4 pack")).otherwise(F.lit(" 3-pack")))
    control = lambda text, chosen: F.struct(text.alias("text"), chosen.alias("chosen"))
    controls = F.array(control(F.lit("Single"), F.lit(False)), control(F.concat(F.lit("Pack of "), F.expr("p_size + 1")), v == 1), control(F.lit("Blue"), F.lit(True)))
    plain = F.array(control(F.lit("Blue"), F.lit(True)), control(F.lit("single"), F.lit(True)))
    packs = prices.card_pack_count(title, text, F.when(v.isin(0, 1, 2), controls).otherwise(plain))
    return table(spark, sf_dir, "part").select("p_partkey", packs.alias("packs"))


EXAMPLE_ERRORS = ("", "not-adjudicated,one-annotator", "n{0}:no-evidence", "n{0}:native-unit,n{0}:not-comparable", "n{0}:quantity-unit,n{0}:not-comparable", "n{0}:price-evidence,n{0}:not-comparable", "n{0}:no-reason", "n{1}:outside-region", "")


@query(
    "training_examples",
    "SELECT p_partkey // 8 AS page_id, ["
    + ", ".join("'" + e.replace("{0}", "' || (2 + 8 * (p_partkey % 8)) || '").replace("{1}", "' || (2 + 8 * ((p_partkey + 6) % 8)) || '") + "'" for e in EXAMPLE_ERRORS)
    + "][p_partkey // 8 % 9 + 1] AS errors FROM part WHERE p_partkey % 8 = 1",
)
def training_examples(spark, sf_dir):
    """Annotated shelves as examples, each with the card at its second place, most with one fault by page."""
    from .shelves import shelf_nodes, shelf_regions

    n = shelf_nodes(spark, sf_dir)
    v, card = F.col("page_id") % 9, F.lit(10)
    nodes = lambda *ids: F.array(*(F.lit(i) for i in ids)).cast("array<int>")
    none = F.lit(None).cast("array<int>")
    evidence = F.when(v != 2, F.struct(F.when(v == 7, nodes(58)).otherwise(nodes(11)).alias("title"), F.when(v == 5, none).otherwise(nodes(14)).alias("price"), nodes(15).alias("native"), nodes(11).alias("quantity")))
    native = F.when(v == 3, F.struct(F.lit(10.0).alias("cents"), F.lit("parsec").alias("unit"), F.lit("length").alias("dimension")))
    quantity = F.when(v != 3, F.struct(F.lit(7.0).alias("value"), F.lit(1).alias("packs"), F.lit("oz").alias("unit"), F.when(v == 4, "volume").otherwise("mass").alias("dimension")))
    product = F.struct(
        card.alias("card"), F.lit("x").alias("title"), (~v.isin(6, 8)).alias("comparable"), F.when(v == 8, "price-range").alias("abstain_reason"), F.lit(480).cast("long").alias("cents"),
        native.alias("native"), quantity.alias("quantity"), evidence.alias("evidence"),
    )
    a = shelf_regions(n).where("page_id is not null").select(
        "page_id", F.when(v == 1, "draft").otherwise("adjudicated").alias("status"), F.lit("complete-main-region").alias("coverage"),
        F.when(v == 1, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("annotators"),
        F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(1000.0).alias("w"), F.lit(600.0).alias("h")).alias("region"), F.array(product).alias("products"),
    )
    return reviews.training_examples(a, n).select("page_id", F.array_join("errors", ",").alias("errors"))


GATES = (
    ("formulation", "grammar_validity", "least", 0.9), ("teacher", "accepted_precision", "least", 0.9), ("teacher", "eligible_coverage", "least", 0.3), ("oracle", "pointer_exact_share", "gain", 0.1),
    ("student", "pointer_exact_share", "regression", 0.2), ("student", "accepted_precision", "least", 0.95), ("browser", "p95_latency_ms", "most", 800.0), ("final", "accepted", "least", 700.0),
    ("final", "precision_bound", "least", 0.99),
)
PHASES = ("formulation", "teacher", "oracle", "student", "browser", "final")


@query(
    "experiment_gates",
    """WITH l AS (SELECT o_orderkey AS run_id, o_orderkey % 6 AS ph, o_orderkey // 6 * 6 + 1 AS parent, o_custkey % 7 <> 0 AS keep, o_custkey % 900 AS ok, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_orderkey % 90 END AS bad, o_custkey % 50 AS exact, o_custkey % 11 + 90 AS valid,
        CASE WHEN o_orderkey % 8 > 0 THEN (o_custkey % 1200)::DOUBLE END AS p95 FROM orders),
    p AS (SELECT l.*, p.run_id AS known, p.exact / 50.0 AS before FROM l LEFT JOIN l p ON p.run_id = l.parent),
    prec AS (SELECT *, CASE WHEN ok + bad = 0 THEN 0 ELSE ok / (ok + bad) END AS prec, exact / 50.0 AS share FROM p WHERE keep),
    f AS (SELECT run_id, 'grammar_validity' AS metric, 'missed' AS issue FROM prec WHERE ph = 0 AND valid / 100 < 0.9
      UNION ALL SELECT run_id, 'accepted_precision', 'missed' FROM prec WHERE ph = 1 AND prec < 0.9 UNION ALL SELECT run_id, 'eligible_coverage', 'missed' FROM prec WHERE ph = 1 AND ok / 1000 < 0.3
      UNION ALL SELECT run_id, 'pointer_exact_share', CASE WHEN known IS NULL THEN 'no-parent' ELSE 'missed' END FROM prec WHERE ph = 2 AND (known IS NULL OR share < before + 0.1)
      UNION ALL SELECT run_id, 'pointer_exact_share', CASE WHEN known IS NULL THEN 'no-parent' ELSE 'missed' END FROM prec WHERE ph = 3 AND (known IS NULL OR share < before - 0.2)
      UNION ALL SELECT run_id, 'accepted_precision', 'missed' FROM prec WHERE ph = 3 AND prec < 0.95
      UNION ALL SELECT run_id, 'p95_latency_ms', CASE WHEN p95 IS NULL THEN 'unknown' ELSE 'missed' END FROM prec WHERE ph = 4 AND (p95 IS NULL OR p95 > 800)
      UNION ALL SELECT run_id, 'accepted', 'missed' FROM prec WHERE ph = 5 AND ok + bad < 700
      UNION ALL SELECT run_id, 'precision_bound', 'missed' FROM prec WHERE ph = 5 AND (bad > 0 OR ok = 0 OR pow(0.05, 1 / ok) < 0.99))
    SELECT run_id, metric, issue FROM f""",
)
def experiment_gates(spark, sf_dir):
    """Kept runs of a ledger that miss a gate of their phase, absolutely or against their parent run."""
    i, c = F.col("o_orderkey"), F.col("o_custkey")
    phase = F.element_at(F.array(*map(F.lit, PHASES)), (i % 6 + 1).cast("int"))
    ledger = table(spark, sf_dir, "orders").select(
        i.alias("run_id"), phase.alias("phase"), (F.floor(i / 6) * 6 + 1).alias("parent_id"), F.when(c % 7 != 0, "keep").otherwise("discard").alias("state"), (c % 900).alias("accepted_correct"),
        F.when(i % 4 == 0, 0).otherwise(i % 90).alias("accepted_incorrect"), F.lit(1000).alias("eligible_comparable"), (c % 50).alias("pointer_exact"), F.lit(50).alias("pointer_total"),
        (c % 11 + 90).alias("grammar_valid"), F.lit(100).alias("grammar_total"), F.when(i % 8 > 0, (c % 1200).cast("double")).alias("p95_latency_ms"),
    )
    gates = spark.createDataFrame(GATES, "phase string, metric string, rule string, bound double")
    return experiments.gate_failures(ledger, gates).select("run_id", "metric", "issue")

"""Review campaigns: independent reviews of a page, the queue of a third reviewer, and the compiled result.

A review is ``(review_id, page_id, reviewer, phase, coverage, visibility, source, source_reviews, products)``, with ``source`` a
text that identifies what was reviewed and ``products`` an array of ``(card, scope, target)``, target being a pointer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grammar
from ..functions.text import let, once, strict_json
from .tree import sorted_join
from .validate import violations

PRODUCTS = "array<struct<card:string,scope:string,target:string>>"
REVIEW = f"struct<review_id:string,page_id:long,reviewer:string,phase:string,completed:string,coverage:string,visibility:string,source:string,source_reviews:array<string>,products:{PRODUCTS}>"
#: What a complete review, and the review of a third person, must say.
COMPLETE, ADJUDICATED, AFTER = "complete-main-region", "adjudicated", "shown-after-submit"
#: How an object begins, and a number in it with a point or an exponent.
OBJECT, BROKEN_NUMBER = r"^\s*\{", r"[:\[,]\s*-?\d+[.eE]"
ISO_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})$"


def product_issues(products: Column) -> Column:
    """What is wrong with single products: ``card:code``, in order; a card that stands twice counts from its second time."""

    def judge(p, i, cards):
        status, own = (grammar.line_value(p["target"], f) for f in ("STATUS", "CARD"))
        form = grammar.pointer_issue(p["target"], any_kind=True)
        outside = p["scope"] == "non-product"
        code = (
            F.when(F.array_position(cards, p["card"]) <= i, "duplicate-card")
            .when(form.isNotNull() | p["target"].isNull(), "invalid-target")
            .when(own != p["card"], "other-card")
            .when(outside & (status != "not-a-product"), "scope-needs-status")
            .when(~outside & (status == "not-a-product"), "status-needs-scope")
        )
        return F.when(code.isNotNull(), F.concat_ws(":", p["card"], code))

    each = lambda xs, cards: F.transform(xs, lambda p, i: judge(p, i, cards))
    return F.array_compact(let(products, lambda xs: let(F.transform(xs, lambda p: p["card"]), lambda cards: each(xs, cards))))


def review_issues(review: Column, expected: Column) -> Column:
    """What is wrong with a review, whose cards should be those of ``expected``; empty for a valid one."""
    r = lambda c: review[c]
    cards = F.transform(r("products"), lambda p: p["card"])
    missing, more = F.array_sort(F.array_except(expected, cards)), F.array_sort(F.array_except(cards, expected))
    blank = lambda c: F.trim(F.coalesce(r(c), F.lit(""))) == ""
    third = r("phase") == ADJUDICATED
    whole = violations(
        ("no-review-id", blank("review_id")),
        ("no-reviewer", blank("reviewer")),
        ("no-time", ~r("completed").rlike(ISO_TIME)),
        ("incomplete", r("coverage") != COMPLETE),
        ("sources-of-two", third & (F.size(F.array_distinct(F.coalesce(r("source_reviews"), F.array().cast("array<string>")))) != 2)),
        ("labels-not-hidden", ~third & (r("visibility") == AFTER)),
    )
    listed = lambda found, code: F.transform(found, lambda c: F.concat(c, F.lit(":" + code)))
    return F.concat(whole, product_issues(r("products")), listed(missing, "omitted"), listed(more, "unexpected"))


def agreement(a: Column, b: Column) -> Column:
    """``struct<cards_a, cards_b, aligned, same>`` of two arrays of products: cards in both, and those with equal targets."""
    pair = lambda xs, full: F.array_distinct(F.transform(xs, lambda p: F.struct(p["card"], p["target"]) if full else p["card"]))
    both = lambda full: F.size(F.array_intersect(pair(a, full), pair(b, full)))
    return F.struct(F.size(pair(a, False)).alias("cards_a"), F.size(pair(b, False)).alias("cards_b"), both(False).alias("aligned"), both(True).alias("same"))


def adjudication_queue(first: DataFrame, second: DataFrame, adjudicator: str) -> DataFrame:
    """What a third reviewer is to decide: one row per page that both reviewed.

    ``first`` and ``second`` have ``page_id`` and ``review``. Returns ``(review_id, page_id, reviewer, source, source_reviews, cards, agreement,
    digest, issues)``; ``digest`` identifies both reviews and their agreement, so that later changes show. Issues: the
    reviewers, or a reviewer and the adjudicator, are one person; the sources differ.
    """
    a, b = F.col("a"), F.col("b")
    rows = first.select("page_id", F.col("review").alias("a")).join(second.select("page_id", F.col("review").alias("b")), "page_id")
    agreed = agreement(a["products"], b["products"])
    cards = F.array_sort(F.array_distinct(F.concat(*(F.transform(x["products"], lambda p: p["card"]) for x in (a, b)))))
    issues = violations(
        ("one-reviewer", a["reviewer"] == b["reviewer"]),
        ("adjudicator-reviewed", (a["reviewer"] == adjudicator) | (b["reviewer"] == adjudicator)),
        ("sources-differ", a["source"] != b["source"]),
    )
    return rows.select(
        F.concat(F.lit(adjudicator + "--"), "page_id").alias("review_id"), "page_id", F.lit(adjudicator).alias("reviewer"), a["source"].alias("source"),
        F.array_sort(F.array(a["review_id"], b["review_id"])).alias("source_reviews"), cards.alias("cards"), agreed.alias("agreement"),
        F.sha2(F.to_json(F.struct("a", "b", agreed.alias("agreement"))), 256).alias("digest"), issues.alias("issues"),
    )


def drifted(queue: DataFrame, first: DataFrame, second: DataFrame, adjudicator: str) -> DataFrame:
    """``(page_id, drift)`` of queued pages: gone, if a review is missing now, or changed, if either or their agreement is another."""
    now = adjudication_queue(first, second, adjudicator).select("page_id", F.col("digest").alias("now"))
    drift = F.when(F.col("now").isNull(), "gone").when(F.col("now") != F.col("digest"), "changed")
    return queue.select("page_id", "digest").join(now, "page_id", "left").select("page_id", drift.alias("drift")).where("drift is not null")


def compile_campaign(queue: DataFrame, submissions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(entries, problems)`` of ``submissions(file, content)``, JSON texts, against a queue.

    ``entries(review_id, page_id, card, scope, target, status)`` are the products of every submission that is right, whatever is wrong
    with others; ``problems(file, review_id, issue)`` are all reasons why others are not, and the reviews that none compiles.
    Of submissions with one id the first by file counts, the rest are duplicates. A changed identity or source, an
    invalid product, or cards omitted or added reject a submission as a whole.
    """
    content = once(submissions.select("file", "content"), v=strict_json(F.col("content")))
    # Writing a variant as text costs more than all else here; an object whose numbers are whole reads the same without.
    text = F.when(F.col("content").rlike(OBJECT) & ~F.col("content").rlike(BROKEN_NUMBER), F.when(F.col("v").isNotNull(), F.col("content"))).otherwise(F.col("v").cast("string"))
    read = once(content.select("file", F.col("v").isNotNull().alias("json"), text.alias("text")), r=F.from_json("text", REVIEW)).drop("text")
    read = read.withColumn("review_id", F.when(F.trim("r.review_id") != "", F.col("r.review_id")))
    # A submission without an id stays by itself, so all are judged in one pass over both sides.
    key = lambda c: F.concat(F.lit("="), c)
    read = read.withColumn("_key", F.coalesce(key("review_id"), F.concat(F.lit("?"), "file")))
    named = read.withColumn("turn", F.row_number().over(Window.partitionBy("_key").orderBy("file"))).withColumn("given", F.lit(True))
    asked = queue.select(key("review_id").alias("_key"), F.col("review_id").alias("wanted"), "cards", F.struct("page_id", "reviewer", "source", "source_reviews").alias("q"))
    met = sorted_join(named, asked, "_key", "full_outer")
    r, q = F.col("r"), F.col("q")
    same = (
        (r["page_id"] == q["page_id"]) & (r["phase"] == ADJUDICATED) & (r["reviewer"] == q["reviewer"]) & (r["coverage"] == COMPLETE)
        & (r["visibility"] == AFTER) & (r["source"] == q["source"]) & (F.array_sort(r["source_reviews"]) == q["source_reviews"])
    )
    one = lambda code: F.array(F.lit(code))
    issues = (
        F.when(F.col("given").isNull(), F.lit(None))
        .when(F.col("review_id").isNull(), F.when(F.col("json"), one("no-review-id")).otherwise(one("not-json")))
        .when(F.col("turn") > 1, one("duplicate"))
        .when(q.isNull(), one("unexpected"))
        .when(~F.coalesce(same, F.lit(False)), one("contract-changed"))
        .otherwise(F.coalesce(review_issues(r, F.col("cards")), one("malformed")))
    )
    met = once(met, issues=issues)
    good = met.where(F.size("issues") == 0)
    entries = good.select("review_id", "r.page_id", F.inline("r.products"))
    entries = entries.withColumn("status", grammar.line_value(F.col("target"), "STATUS"))
    problem = lambda file, ident, issue: F.struct(file.alias("file"), ident.alias("review_id"), issue.alias("issue"))
    told = F.coalesce(F.transform("issues", lambda x: problem(F.col("file"), F.col("review_id"), x)), F.array())
    # Only the first submission of an id can be right; without one a queued review is missing.
    lacking = F.col("wanted").isNotNull() & (F.col("given").isNull() | ((F.col("turn") == 1) & (F.size("issues") > 0)))
    missing = F.when(lacking, F.array(problem(F.lit(None).cast("string"), F.col("wanted"), F.lit("missing")))).otherwise(F.array())
    return entries, met.select(F.inline(F.concat(told, missing)))


def adjudication_issues(third: Column, a: Column, b: Column) -> Column:
    """What is wrong with the review of a third person, given both independent ones: who, when, of what, and which cards."""
    cards = lambda r: F.array_distinct(F.transform(r["products"], lambda p: p["card"]))
    known, both = F.array_union(cards(a), cards(b)), F.array_intersect(cards(a), cards(b))
    moment = lambda r: F.try_to_timestamp(r["completed"])
    whole = violations(
        ("not-adjudicated", third["phase"] != ADJUDICATED),
        ("same-person", (third["reviewer"] == a["reviewer"]) | (third["reviewer"] == b["reviewer"])),
        ("not-later", F.coalesce(moment(third) <= F.greatest(moment(a), moment(b)), F.lit(False))),
        ("other-sources", F.array_sort(F.coalesce(third["source_reviews"], F.array().cast("array<string>"))) != F.array_sort(F.array(a["review_id"], b["review_id"]))),
    )
    listed = lambda found, code: F.transform(F.array_sort(found), lambda c: F.concat(c, F.lit(":" + code)))
    return F.concat(
        whole, product_issues(third["products"]), listed(F.array_except(known, both), "disputed-root"),
        listed(F.array_except(known, cards(third)), "omitted"), listed(F.array_except(cards(third), known), "unreviewed"),
    )


def campaign_provenance(pages: DataFrame, eligible: DataFrame, retired: DataFrame, fields: list[str]) -> DataFrame:
    """``pages(campaign, page_id, cards, fields)`` with ``origin`` (eligible, retired or null) and ``issues``.

    A page must be exactly what a registry holds on all ``fields``, eligible first; stand once in its campaign; and have cards.
    """
    keys = ["page_id", *fields]
    mark = lambda r, name: r.select(*keys).distinct().withColumn(name, F.lit(True))
    times = pages.groupBy("campaign", "page_id").agg(F.count("*").alias("times"))
    rows = pages.join(mark(eligible, "eligible"), keys, "left").join(mark(retired, "retired"), keys, "left").join(times, ["campaign", "page_id"])
    origin = F.when(F.col("eligible"), "eligible").when(F.col("retired"), "retired")
    issues = violations(("repeated-page", F.col("times") > 1), ("no-cards", F.coalesce(F.col("cards"), F.lit(0)) <= 0), ("unknown-evidence", origin.isNull()))
    return rows.withColumn("origin", origin).withColumn("issues", issues).drop("eligible", "retired", "times")


def training_examples(annotations: DataFrame, nodes: DataFrame, single: bool = False) -> DataFrame:
    """``(page_id, errors, products)``: annotated pages as examples for training, or why they are none.

    ``annotations`` has ``page_id, status, coverage, annotators, region<x,y,w,h>`` and ``products``, an array of ``card, title, comparable,
    abstain_reason, cents, native<cents,unit,dimension>, quantity<value,packs,unit,dimension>, evidence<title,price,native,quantity>``
    with node numbers in ``evidence``. A page must be adjudicated, wholly covered and, unless ``single``, seen by two. Every
    value needs evidence, units must be known and of the dimension they claim, and a comparable product needs a rate, or a
    price with a quantity. All that is cited must lie in the crop of the region. ``products`` is null where there are errors.
    """
    from ..functions import units
    from .observation import crop

    has = lambda c: c.isNotNull()
    own = F.col("products")

    def judge(p):
        e, native, q = p["evidence"], p["native"], p["quantity"]
        unit, measure = units.parse_unit(native["unit"]), units.parse_unit(q["unit"])
        named = lambda code: F.concat(F.lit("n"), p["card"].cast("string"), F.lit(":" + code))
        priced = has(p["cents"]) & has(e["price"])
        rated = has(native) & has(unit) & has(e["native"])
        sized = has(q) & has(measure) & (units.dimension_of(measure) == q["dimension"]) & has(e["quantity"])
        comparable = F.coalesce(p["comparable"], F.lit(False))
        codes = (
            (e.isNull(), "no-evidence"),
            (has(e) & ~comparable & p["abstain_reason"].isNull(), "no-reason"),
            (has(e) & comparable & has(p["cents"]) & ~priced, "price-evidence"),
            (has(e) & comparable & has(native) & unit.isNull(), "native-unit"),
            (has(e) & comparable & has(native) & has(unit) & ~rated, "native-evidence"),
            (has(e) & comparable & has(q) & (measure.isNull() | (units.dimension_of(measure) != q["dimension"])), "quantity-unit"),
            (has(e) & comparable & sized.eqNullSafe(F.lit(False)) & has(q) & has(measure) & e["quantity"].isNull(), "quantity-evidence"),
            (has(e) & comparable & ~F.coalesce(rated, F.lit(False)) & ~F.coalesce(priced & sized, F.lit(False)), "not-comparable"),
        )
        return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), named(code)) for c, code in codes)))

    page = violations(
        ("not-adjudicated", F.col("status") != ADJUDICATED),
        ("incomplete", F.col("coverage") != COMPLETE),
        ("no-region", F.col("region").isNull()),
        ("one-annotator", F.lit(not single) & (F.size(F.coalesce("annotators", F.array().cast("array<string>"))) < 2)),
    )
    rows = annotations.withColumn("own", F.concat(page, F.coalesce(F.flatten(F.transform(own, judge)), F.array().cast("array<string>"))))
    empty = F.array().cast("array<int>")
    used = lambda p, k, value: F.coalesce(F.when(F.coalesce(p["comparable"], F.lit(False)) & has(p[value]), p["evidence"][k]), empty)
    pairs = (("price", "cents"), ("native", "native"), ("quantity", "quantity"))
    each = lambda p: F.concat(F.array(p["card"]), F.coalesce(p["evidence"]["title"], empty), *(used(p, *x) for x in pairs))
    cited = rows.select("page_id", F.explode_outer(F.array_distinct(F.flatten(F.transform(own, each)))).alias("node")).where("node is not null")
    views = rows.where("region is not null").select("page_id", F.lit(0).alias("view"), "region.x", "region.y", "region.w", "region.h")
    outside = sorted_join(cited, crop(nodes, views).select("page_id", "node"), ["page_id", "node"], "left_anti")
    outside = outside.groupBy("page_id").agg(F.array_sort(F.collect_set("node")).alias("outside"))
    out = sorted_join(rows, outside, "page_id", "left")
    gone = F.transform(F.coalesce("outside", empty), lambda n: F.concat(F.lit("n"), n.cast("string"), F.lit(":outside-region")))
    out = out.withColumn("errors", F.when(F.size("own") > 0, F.col("own")).otherwise(gone))
    return out.select("page_id", "errors", F.when(F.size("errors") == 0, own).alias("products"))

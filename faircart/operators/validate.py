"""Constraints as columns: every rule names what it finds, and a row's findings are one array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, prices
from ..functions.grammar import approximately_equal


def violations(*rules: tuple[str, Column]) -> Column:
    """The names of the rules that are broken, in their order; a rule that cannot be judged is broken."""
    return F.array_compact(F.array(*(F.when(F.coalesce(broken, F.lit(True)), name) for name, broken in rules)))


def capture_gates(captures: DataFrame, registry: DataFrame, least: int = 8, obstructed: float = 0.2) -> DataFrame:
    """``captures`` with ``issues``: why a capture may not be used.

    ``captures`` has page_id, blocked, candidates, truncated, obstruction, coverage, screenshot and hash; ``registry`` has page_id and hash.
    """
    known = registry.select("page_id", F.col("hash").alias("known"))
    joined = captures.join(known, "page_id", "left")
    issues = violations(
        ("blocked", F.col("blocked")),
        ("too-few-candidates", F.col("candidates") < least),
        ("truncated", F.col("truncated")),
        ("obstructed", F.col("obstruction") > obstructed),
        ("query-not-covered", F.col("coverage") < 1),
        ("no-screenshot", ~F.col("screenshot")),
        ("not-registered", F.col("known").isNull()),
        ("hash-mismatch", F.col("known").isNotNull() & (F.col("known") != F.col("hash"))),
    )
    return joined.withColumn("issues", issues).drop("known")


def money_in(text: Column) -> Column:
    """The amounts in cents that a cited text holds as prices: those that a unit follows are rates."""
    found = prices.parse_money(text)
    after = lambda m: F.substring(text, m["idx"] + F.length(m["source"]) + 1, F.lit(12))
    return F.transform(F.filter(found, lambda m: ~after(m).rlike(r"(?i)^\s*(?:/|per\b)")), lambda m: m["cents"])


def is_grounded(text: Column, cents: Column) -> Column:
    """Whether a price stands literally in the text that is cited for it."""
    return F.array_contains(money_in(text), cents)


def grounded_quantity(text: Column, value: Column, unit: Column) -> Column:
    """Whether a quantity stands in the text that is cited for it."""
    return F.exists(prices.parse_quantities(text), lambda q: approximately_equal(q["value"], value) & (q["unit"] == unit))


def validate_extractions(rows: DataFrame) -> DataFrame:
    """``rows`` with ``issues`` and ``status`` (rejected, abstained or accepted).

    ``rows`` has page_id, card, card_text, title, cents, value, unit and abstain_reason. A card that is named twice on a page, or
    values that its text does not hold, reject a product; an abstention carries no values.
    """
    twice = rows.groupBy("page_id", "card").agg(F.count("*").alias("times"))
    rows = rows.join(twice, ["page_id", "card"])
    abstains, text = F.col("abstain_reason").isNotNull(), F.col("card_text")
    has = lambda c: F.col(c).isNotNull()
    issues = violations(
        ("duplicate-card", F.col("times") > 1),
        ("title-not-in-evidence", ~F.contains(F.lower(text), F.lower("title"))),
        ("values-with-abstention", abstains & (has("cents") | has("value"))),
        ("missing-values", ~abstains & ~(has("cents") & has("value"))),
        ("price-not-in-evidence", F.coalesce(~abstains & has("cents") & ~is_grounded(text, F.col("cents")), F.lit(False))),
        ("quantity-not-in-evidence", F.coalesce(~abstains & has("value") & ~grounded_quantity(text, F.col("value"), F.col("unit")), F.lit(False))),
    )
    rows = rows.withColumn("issues", issues).drop("times")
    return rows.withColumn("status", F.when(F.size("issues") > 0, "rejected").when(abstains, "abstained").otherwise("accepted"))


def audit_campaign(queue: DataFrame, submissions: DataFrame, key: str) -> DataFrame:
    """``(key, state)``: accepted, or why a submission is put aside (malformed, unexpected, duplicate), or missing.

    ``submissions`` has the key and ``parsed``, whether it could be read.
    """
    seen = submissions.groupBy(key).agg(F.count("*").alias("n"), F.min(F.col("parsed").cast("int")).alias("ok"))
    both = queue.select(key, F.lit(True).alias("asked")).distinct().join(seen, key, "full_outer")
    state = (
        F.when(F.col("n").isNull(), "missing").when(F.col("asked").isNull(), "unexpected").when(F.col("ok") == 0, "malformed").when(F.col("n") > 1, "duplicate").otherwise("accepted")
    )
    return both.select(key, state.alias("state"))


def same_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other: ``side`` and the columns of both."""
    a, b = left.exceptAll(right), right.exceptAll(left)
    return a.withColumn("side", F.lit("left")).unionByName(b.withColumn("side", F.lit("right")))


def divergence(native: Column, cents: Column, quantity: Column, most: float = 0.2) -> Column:
    """Whether a printed rate and price over quantity differ by more than ``most`` of the rate."""
    return F.coalesce(F.abs(cents / quantity - native) / native > most, F.lit(False))


def evidence_mode(native: Column, price: Column, quantity: Column) -> Column:
    """What a label rests on: both, native, package or none."""
    package = price & quantity
    return F.when(native & package, "both").when(native, "native").when(package, "package").otherwise("none")


def abstention_reason(quantities: Column, negative: Column) -> Column:
    """Why a product is left out: no quantity, a price with a condition, or too little else."""
    return F.when(quantities == 0, "ambiguous-quantity").when(negative, "conditional-price").otherwise("insufficient-evidence")


def title_links(links: DataFrame, by: list[str]) -> DataFrame:
    """The link that is a card's title: by class, product path, vendor and collection marks, then length.

    ``links`` has text, classes and path.
    """
    from .selection import first_n

    score = (
        F.when(F.col("classes").rlike("(?i)title|name"), 8).otherwise(0)
        + F.when(F.col("path").rlike("(?i)/(?:products?|dp|ip|p)/"), 5).otherwise(0)
        - F.when(F.col("classes").rlike("(?i)vendor|brand"), 6).otherwise(0)
        - F.when(F.col("path").rlike("(?i)/(?:collections?|vendors?)/"), 6).otherwise(0)
    )
    known = links.where(classify.clean_candidate_title(F.col("text")).isNotNull()).withColumn("score", score)
    return first_n(known, by, 1, F.desc("score"), F.desc(F.length("text")), "text")


def line_title(text: Column) -> Column:
    """The first line of a card with a product word."""
    return F.try_element_at(F.filter(F.split(text, "\n"), lambda x: x.rlike("(?i)" + classify.PRODUCT_WORDS)), F.lit(1))


def box_is_valid(x: Column, y: Column, w: Column, h: Column, most: float = 1000.0) -> Column:
    """Finite, with an area, and inside the page of ``most`` by ``most``."""
    finite = ~(F.isnan(x) | F.isnan(y) | F.isnan(w) | F.isnan(h))
    return F.coalesce(finite & (w > 0) & (h > 0) & (x >= 0) & (y >= 0) & (x + w <= most) & (y + h <= most), F.lit(False))


def match_boxes(pairs: DataFrame, page: str) -> DataFrame:
    """One-to-one matches of ``pairs(page, predicted, target, iou)``, the largest overlap first.

    Every choice bars later ones of its page, so a page's pairs, which its number of boxes bounds, are walked in order.
    """
    import pandas as pd

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        left, right, kept = set(), set(), []
        for r in part.sort_values(["iou", "predicted", "target"], ascending=[False, True, True]).itertuples():
            if r.predicted not in left and r.target not in right:
                left.add(r.predicted)
                right.add(r.target)
                kept.append(r.Index)
        return part.loc[kept, [page, "predicted", "target"]]

    kinds = dict(pairs.dtypes)
    return pairs.groupBy(page).applyInPandas(walk, f"{page} {kinds[page]}, predicted {kinds['predicted']}, target {kinds['target']}")

"""Closed shapes of JSON documents: which keys may stand where, and what stands there instead."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Takes a variant and the place it stands at, and gives what is wrong there as ``place:code``.
Shape = Callable[[Column, Column], Column]
NONE = "array<string>"


def kind(v: Column) -> Column:
    """The type of a variant, without what it holds: OBJECT, ARRAY, STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN or VOID."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def nothing() -> Column:
    return F.array().cast(NONE)


def fault(at: Column, code: str) -> Column:
    return F.array(F.concat(at, F.lit(":" + code)))


def only(test: Callable[[Column], Column], code: str) -> Shape:
    """A value that passes ``test``."""
    return lambda v, at: F.when(F.coalesce(test(v), F.lit(False)), nothing()).otherwise(fault(at, code))


def text(filled: bool = False) -> Shape:
    return only(lambda v: (kind(v) == "STRING") & (~F.lit(filled) | (F.trim(F.try_variant_get(v, "$", "string")) != "")), "not-a-text")


def number() -> Shape:
    return only(lambda v: kind(v).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT"), "not-a-number")


def literal(*values) -> Shape:
    """One of some texts, or one number."""
    if isinstance(values[0], str):
        return only(lambda v: (kind(v) == "STRING") & F.try_variant_get(v, "$", "string").isin(*values), "not-allowed")
    return only(lambda v: (kind(v) != "STRING") & F.try_variant_get(v, "$", "double").isin(*map(float, values)), "not-allowed")


def several(item: Shape, least: int = 0, distinct: bool = False) -> Shape:
    """An array of ``item``; places count from 0."""

    def check(v: Column, at: Column) -> Column:
        def judge(held):
            own = F.flatten(F.transform(held, lambda x, i: item(x, F.concat(at, F.lit("["), i.cast("string"), F.lit("]")))))
            parts = [F.when(F.size(held) < least, fault(at, "too-few")).otherwise(nothing())]
            if distinct:
                unlike = let(F.transform(held, lambda x: F.to_json(x)), lambda texts: F.size(F.array_distinct(texts)) < F.size(texts))
                parts.append(F.when(unlike, fault(at, "repeated")).otherwise(nothing()))
            return F.when(held.isNotNull(), F.concat(*parts, own)).otherwise(fault(at, "not-an-array"))

        return let(F.try_variant_get(v, "$", "array<variant>"), judge)

    return check


def closed(required: dict[str, Shape], optional: dict[str, Shape] | None = None) -> Shape:
    """An object with all ``required`` keys, any ``optional`` ones and no others; unknown keys are named, first of all."""
    optional = optional or {}

    def check(v: Column, at: Column) -> Column:
        below = lambda k: F.concat(at, F.lit("."), k)

        def judge(held):
            unknown = F.transform(F.filter(F.map_keys(held), lambda k: ~k.isin(*required, *optional)), lambda k: F.concat(below(k), F.lit(":unknown-key")))
            parts = [unknown]
            for name, shape in (required | optional).items():
                place = below(F.lit(name))
                absent = fault(place, "missing") if name in required else nothing()
                child = F.try_element_at(held, F.lit(name))
                parts.append(let(child, lambda x, shape=shape, place=place, absent=absent: F.when(x.isNull(), absent).otherwise(shape(x, place))))
            return F.when(held.isNotNull(), F.concat(*parts)).otherwise(fault(at, "not-an-object"))

        return let(F.try_variant_get(v, "$", "map<string,variant>"), judge)

    return check


def faults(document: Column, shape: Shape) -> Column:
    """All that is wrong with a JSON text, by place, ``$`` being the whole; one fault for null or what is no JSON."""
    return let(F.try_parse_json(document), lambda v: F.when(v.isNull(), F.array(F.lit("$:not-json"))).otherwise(shape(v, F.lit("$"))))


# Keys and statuses of an extracted page.
ABSTENTIONS = ("insufficient-evidence", "conditional-price", "price-range", "unselected-variant", "ambiguous-quantity", "unsupported-unit", "not-a-product")


def page_extraction() -> Shape:
    """The shape of what a model extracts from a page."""
    cited = several(text(filled=True), least=1, distinct=True)
    measured = {"unit": text(), "dimension": text(), "evidenceNodeIds": cited}
    product = closed(
        {"cardNodeId": text(filled=True), "title": closed({"value": text(filled=True), "evidenceNodeIds": cited})},
        {
            "currentPrice": closed({"cents": number(), "currency": literal("USD"), "evidenceNodeIds": cited}),
            "nativeUnitPrice": closed({"centsPerUnit": number()} | measured),
            "packageQuantity": closed({"valuePerPackage": number(), "packCount": number()} | measured),
            "abstainReason": literal(*ABSTENTIONS),
        },
    )
    return closed({"version": literal(1), "pageId": text(), "products": several(product)})

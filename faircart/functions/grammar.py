"""The two textual answers of an extraction model, a seven-line pointer and a 22-character selection, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strict_json

# Fields and statuses in their order, with the letters of the selection.
FIELDS = ("CARD", "TITLE", "CURRENT_PRICE", "NATIVE_UNIT_PRICE", "PACKAGE_QUANTITY", "PACK_COUNT", "STATUS")
STATUS_CODES = {
    "comparable": "C",
    "insufficient-evidence": "E",
    "conditional-price": "D",
    "price-range": "R",
    "unselected-variant": "V",
    "ambiguous-quantity": "Q",
    "unsupported-unit": "U",
    "not-a-product": "N",
}
NODE = r"^[A-Za-z0-9._:-]+$"
KINDS = {"CURRENT_PRICE": "p", "NATIVE_UNIT_PRICE": "u", "PACKAGE_QUANTITY": "q", "PACK_COUNT": "k"}
SELECTION = r"^T([0-9A-Z]{2}) P([0-9A-Z]{2}|--) U([0-9A-Z]{2}|--) Q([0-9A-Z]{2}|--) K([0-9A-Z]{2}|--) S([CEDRVQUN])$"


def pointer_fields(text: Column) -> Column:
    """The seven values of a pointer in the order of ``FIELDS``; null where the form is broken."""
    formed = (text == F.trim(text)) & ~F.contains(text, F.lit("\r")) & ~F.contains(text, F.lit("```"))

    def values(lines):
        each = [F.when(F.startswith(F.get(lines, F.lit(i)), F.lit(f + " ")), F.substring(F.get(lines, F.lit(i)), F.lit(len(f) + 2), F.length(text))) for i, f in enumerate(FIELDS)]
        return F.when(F.size(lines) == len(FIELDS), F.array(*each))

    def whole(found):
        return F.when(formed & F.forall(found, lambda e: F.coalesce(e != "", F.lit(False))), found)

    return let(let(F.split(text, "\n"), values), whole)


def pointer_issue(text: Column, any_kind: bool = False) -> Column:
    """The first thing wrong with a pointer by code; null for a valid one.

    A candidate must be of its field's kind, unless ``any_kind`` leaves that to whoever looks it up.
    """
    lines = F.split(text, "\n")
    outer = (text != F.trim(text)) | F.contains(text, F.lit("\r")) | F.contains(text, F.lit("```"))

    def judge(values):
        value = dict(zip(FIELDS, (F.get(values, F.lit(i)) for i in range(len(FIELDS))), strict=True))
        nodes = F.split(value["TITLE"], ",")
        bad_nodes = ~value["CARD"].rlike(NODE) | ~F.forall(nodes, lambda n: n.rlike(NODE)) | (F.size(F.array_distinct(nodes)) < F.size(nodes))
        given = {f: value[f] != "NONE" for f in KINDS}
        bad_value = reduce(lambda a, b: a | b, [given[f] & ~value[f].rlike(rf"^[A-Za-z0-9._:-]+@{'[puqk]' if any_kind else k}\d+$") for f, k in KINDS.items()])
        comparable = value["STATUS"] == "comparable"
        some = reduce(lambda a, b: a | b, given.values())
        priced = given["NATIVE_UNIT_PRICE"] | (given["CURRENT_PRICE"] & given["PACKAGE_QUANTITY"])
        return (
            F.when(text.isNull(), "invalid-output-type")
            .when(outer | (F.size(lines) != len(FIELDS)), "invalid-line-count")
            .when(values.isNull(), "invalid-field")
            .when(bad_nodes, "invalid-node")
            .when(bad_value, "invalid-candidate")
            .when(~value["STATUS"].isin(*STATUS_CODES), "invalid-status")
            .when((~comparable & some) | (comparable & ~priced) | (given["PACK_COUNT"] & ~given["PACKAGE_QUANTITY"]), "incompatible-status")
        )

    return let(pointer_fields(text), judge)


def line_value(pointer: Column, field: str) -> Column:
    """A field of a pointer whose form is right, without another look at the form."""
    return F.regexp_replace(F.get(F.split(pointer, "\n"), F.lit(FIELDS.index(field))), "^[A-Z_]+ ", "")


def serialize_pointer(card: Column, titles: Column, values: dict[str, Column], status: Column) -> Column:
    """The seven lines of a pointer; absent values are NONE."""
    parts = [card, F.array_join(titles, ","), *(F.coalesce(values[f], F.lit("NONE")) for f in KINDS), status]
    return F.concat_ws("\n", *(F.concat(F.lit(f + " "), p) for f, p in zip(FIELDS, parts, strict=True)))


def selection_issue(text: Column) -> Column:
    """What is wrong with a selection by code; null for a valid one."""
    part = [F.regexp_extract(text, SELECTION, i) for i in range(1, 7)]
    price, native, quantity, pack = (p != "--" for p in part[1:5])
    comparable = part[5] == "C"
    return (
        F.when(text.isNull(), "invalid-output-type")
        .when(~text.rlike(SELECTION), "invalid-field")
        .when(comparable & ~native & ~(price & quantity), "incompatible-status")
        .when(~comparable & (price | native | quantity | pack), "incompatible-status")
    )


def serialize_selection(title: Column, price: Column, native: Column, quantity: Column, pack: Column, status: Column) -> Column:
    """The selection line from two-character codes; absent values are ``--``."""
    code = F.element_at(F.create_map(*(F.lit(x) for pair in STATUS_CODES.items() for x in pair)), status)
    out = F.concat(F.lit("T"), title)
    for letter, value in (("P", price), ("U", native), ("Q", quantity), ("K", pack)):
        out = F.concat(out, F.lit(" " + letter), F.coalesce(value, F.lit("--")))
    return F.concat(out, F.lit(" S"), code)


def approximately_equal(left: Column, right: Column) -> Column:
    """Equal within a thousandth, or a ten-thousandth of the right value."""
    return F.abs(left - right) <= F.greatest(F.lit(0.001), F.abs(right) * 0.0001)


def json_prefix(text: Column) -> Column:
    """The first balanced ``{...}`` of a text, with regard to strings and escapes; the whole text if it is JSON, else null."""
    start = F.instr(text, "{")
    chars = F.split(F.substring(text, start, F.length(text)), "")
    zero = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(s, c):
        depth = F.when(s["quoted"], s["depth"]).when(c == "{", s["depth"] + 1).when(c == "}", s["depth"] - 1).otherwise(s["depth"])
        quoted = F.when(s["quoted"], s["escaped"] | (c != '"')).otherwise(c == '"')
        closed = (s["end"] == 0) & ~s["quoted"] & (c == "}") & (depth == 0)
        return F.struct(
            depth.alias("depth"),
            quoted.alias("quoted"),
            (s["quoted"] & ~s["escaped"] & (c == "\\")).alias("escaped"),
            (s["at"] + 1).alias("at"),
            F.when(closed, s["at"] + 1).otherwise(s["end"]).alias("end"),
        )

    end = F.aggregate(chars, zero, step, lambda s: s["end"])
    part = F.when((start > 0) & (end > 0), F.substring(text, start, end))
    return F.when(strict_json(text).isNotNull(), text).when(strict_json(part).isNotNull(), part)

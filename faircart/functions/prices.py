"""Money, unit prices, quantities and pack counts out of text, as column expressions.

Each parser first gates on a cheap pattern (``find_all`` does), so texts without a match cost one
scan. Texts should have passed ``plain_space``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import units
from .text import ascii_words, ci, find_all, group, js_round, let, matches, to_fixed, trim_zeros

UNIT = units.unit_pattern()
# The patterns of the parsers. NUM is a number, AFTER what may follow a unit.
NUM = r"\d+(?:\.\d+)?"
AFTER = r"(?=\b|\W)"
MONEY = r"\$\s*([0-9]{1,5})\s+([0-9]{2})\b|\$\s*([0-9]{1,5})(?:,([0-9]{3}))*(?:\.([0-9]{2}))?\b"
NATIVE = (
    r"(?:\$\s*([0-9]+(?:[.,][0-9]+)?)|([0-9]+(?:[.,][0-9]+)?)\s*(?:¢|cents?))\s*(?:[(\[]\s*)?(?:/|per\s+)\s*(?:linear\s+)?"
    rf"({UNIT}){AFTER}"
)
PER_UNIT = rf"(?:/|\bper\s+)\s*({UNIT}){AFTER}"
PACK_OF = rf"(\d+)\s*(?:pack|pk)\s+of\s+({NUM})\s*({UNIT}){AFTER}"
TIMES = rf"({NUM})\s*(?:x|×|by)\s*({NUM})\s*(?:-\s*)?({UNIT}){AFTER}"
WIDTH_BY_LENGTH = rf"{NUM}\s*(?:\"|inch(?:es)?|in\.?)\s*(?:x|×|by)\s*({NUM})\s*(ft|feet|foot|yds?\.?|yards?){AFTER}"
PER_CASE = r"\b(\d{1,6})\s*/\s*(?:cs|case|pk|pack)\b"
PLAIN = rf"({NUM})\s*(?:-\s*)?({UNIT}){AFTER}"
PACK_COUNTS = (
    r"\b(\d{1,3})\s*(?:-\s*)?(?:pack|pk)\b",
    r"\b(?:pack|pk)\s+of\s+(\d{1,3})\b",
    r"\b(?:case|carton|box)\s+of\s+(\d{1,3})\b",
    r"\b(\d{1,3})\s+per\s+(?:case|carton|box)\b",
    r"\b(\d{1,3})\s+(?:rolls?|reams?|packs?|bags?|bottles?)\s*/\s*(?:case|carton|box)\b",
    r"\b(\d{1,3})\s*/\s*(?:bag|box|bx|pallet)\b",
    r"\b(\d{1,3})\s*(?:per|/)\s*pallet\b",
    r"\b(?:box|bx)\s+of\s+(\d{1,3})\b",
    r"\b(\d{1,3})\s+(?:cartons?|cases?)\b",
    r"\b(\d{1,3})\s*/\s*(?:carton|case)\b",
    r"\btotal\s+qty\s+(\d{1,3})\b",
)
FACTORED = (
    (rf"(\d{{1,3}})\s*(?:x|×)\s*({NUM})\s*(?:-\s*)?({UNIT}){AFTER}", 2, 3, 1),
    (rf"({NUM})\s*({UNIT}){AFTER}\s*(?:x|×)\s*(\d{{1,3}})\s*(?:pack|pk)?\b", 1, 2, 3),
    (rf"(\d{{1,3}})\s*(?:pack|pk)\s+of\s+({NUM})\s*({UNIT}){AFTER}", 2, 3, 1),
)
MOST_CENTS = 500_000
QUANTITY = "array<struct<value:double,unit:string,dimension:string,source:string,idx:int,rank:int>>"


def parse_money(text: Column) -> Column:
    """Dollar amounts: ``array<struct<cents, source, idx>>``; only 1 to 500,000 cents."""
    pattern = ascii_words(MONEY)

    def money(m):
        part = lambda n: group(m.value, pattern, n)
        whole = F.coalesce(part(1), F.concat(part(3), F.coalesce(part(4), F.lit(""))))
        cents = F.coalesce(F.when(part(1).isNotNull(), part(2)).otherwise(part(5)), F.lit("00"))
        return F.struct((whole.cast("long") * 100 + cents.cast("long")).alias("cents"), m.value.alias("source"), m.start.alias("idx"))

    return F.filter(F.transform(find_all(text, pattern), money), lambda x: x.cents.between(1, MOST_CENTS))


def best_price(text: Column) -> Column:
    """The money that its surroundings speak for most; the first of equals."""
    low = F.lower(text)

    def scored(x):
        start = F.greatest(x.idx - 28, F.lit(0))
        around = F.substring(low, start + 1, x.idx + F.length(x.source) + 28 - start)
        left = F.greatest(x.idx - 8, F.lit(0))
        before = F.substring(low, left + 1, x.idx - left)
        one, more = before.rlike(ascii_words(r"\b1\s*/\s*$")), before.rlike(ascii_words(r"\b(?:[2-9]|\d{2,})\s*/\s*$"))
        score = (
            F.when(around.rlike("current price|now|sale|price"), 3).otherwise(0)
            - F.when(around.rlike(r"was|list price|reg\.|regular|save"), 3).otherwise(0)
            + F.when(one, 8).when(more, -4).otherwise(0)
        )
        return F.struct((-score).alias("order"), x.idx.alias("idx"), x.cents.alias("cents"), x.source.alias("source"))

    best = F.try_element_at(F.array_sort(F.transform(parse_money(text), scored)), F.lit(1))
    return F.when(best.isNotNull(), F.struct(best.cents.alias("cents"), best.source.alias("source"), best.idx.alias("idx")))


def round_unit_price(value: Column) -> Column:
    return js_round(value * 1_000_000) / 1_000_000


def parse_native_prices(text: Column) -> Column:
    """Printed unit prices: ``array<struct<cents, unit, dimension, source, idx>>`` in cents per unit."""
    pattern = ci(NATIVE)

    def price(m):
        dollars, cents = group(m.value, pattern, 1), group(m.value, pattern, 2)
        amount = F.regexp_replace(F.coalesce(dollars, cents), ",", ".").cast("double")
        unit = units.parse_unit(group(m.value, pattern, 3))
        value = round_unit_price(F.when(dollars.isNotNull(), amount * 100).otherwise(amount))
        return F.struct(
            value.alias("cents"), unit.alias("unit"), units.dimension_of(unit).alias("dimension"), m.value.alias("source"), m.start.alias("idx")
        )

    return F.filter(F.transform(find_all(text, pattern), price), lambda x: x.unit.isNotNull() & (x.cents > 0))


def parse_per_unit(text: Column) -> Column:
    """Labels that only name a unit, as "per sq ft": ``array<struct<unit, dimension, source, idx>>``."""
    pattern = ci(PER_UNIT)

    def label(m):
        unit = units.parse_unit(group(m.value, pattern, 1))
        return F.struct(unit.alias("unit"), units.dimension_of(unit).alias("dimension"), m.value.alias("source"), m.start.alias("idx"))

    return F.filter(F.transform(find_all(text, pattern), label), lambda x: x.unit.isNotNull())


def _quantity(m, value, raw_unit, rank: int):
    unit = units.parse_unit(raw_unit)
    return F.struct(
        value.alias("value"), unit.alias("unit"), units.dimension_of(unit).alias("dimension"), m.value.alias("source"), m.start.alias("idx"), F.lit(rank).alias("rank")
    )


def parse_quantities(text: Column) -> Column:
    """Package quantities; plain ones only outside what the composite forms took up.

    First of equal (value, unit, place) wins. Numbers after letters, digits, slashes, "per" or
    currency signs are no quantities, nor are five-digit codes before a count word.
    """
    forms = (
        (ci(PACK_OF), 2, (1, 2), 3),
        (ci(TIMES), 3, (1, 2), 3),
        (ci(WIDTH_BY_LENGTH), 3, (1,), 2),
        (ci(PER_CASE), 2, (1,), None),
    )
    plain = ci(PLAIN)

    def composite(m, pattern, rank, numbers, unit):
        value = reduce(lambda a, b: a * b, [group(m.value, pattern, n).cast("double") for n in numbers])
        return _quantity(m, value, F.lit("each") if unit is None else group(m.value, pattern, unit), rank)

    def body(spans):
        # spans: one array of matches for each form, in order
        found = [
            F.transform(spans[i], _unary(lambda m, form=form: composite(m, *form))) for i, form in enumerate(forms)
        ]
        taken = F.flatten(spans)

        def free(m):
            before = F.lower(F.substring(text, F.greatest(m.start - 12, F.lit(0)) + 1, F.least(m.start, F.lit(12))))
            close = F.substring(before, F.greatest(F.length(before) - 3, F.lit(1)), F.lit(4))
            return ~(before.rlike(r"(?:[a-z0-9]|/|per\s+|¢\s*)$") | close.rlike(r"[$€£]\s*$"))

        def outside(taken):
            return F.filter(find_all(text, plain), lambda m: ~F.exists(taken, lambda t: (m.start >= t.start) & (m.start < t.end)) & free(m))

        rest = F.transform(let(taken, outside), lambda m: _quantity(m, group(m.value, plain, 1).cast("double"), group(m.value, plain, 2), 2))
        return F.concat(*found, rest)

    code = lambda q: (q.unit == "each") & (q.value >= 10_000) & q.source.rlike(r"(?i)^\d{5,}(?:ct\.?|count|each|ea)$")
    found = let(F.array(*(find_all(text, form[0]) for form in forms)), body)
    valid = F.filter(found, lambda q: q.unit.isNotNull() & (q.value > 0) & (q.value <= 100_000) & ~code(q))
    return F.when(text.rlike(r"\d"), dedupe_quantities(valid)).otherwise(F.when(text.isNotNull(), F.array().cast(QUANTITY)))


def _unary(f):
    return lambda m: f(m)


def dedupe_quantities(quantities: Column) -> Column:
    """The first of equal (value, unit, place)."""
    key = lambda q: F.struct(q.value.alias("v"), q.unit.alias("u"), q.idx.alias("i"))
    return _first_of_equal(quantities, key)


def _first_of_equal(items: Column, key) -> Column:
    """Elements whose key no earlier element has."""

    def body(xs):
        return let(F.transform(xs, _unary(key)), lambda keys: F.filter(xs, lambda x, i: F.array_position(keys, key(x)) == i + 1))

    return let(items, body)


def pack_count(text: Column) -> Column:
    """Items in a pack by the first pattern that gives more than one; null without any."""
    numbers = [F.regexp_extract(text, ci(p), 1).try_cast("int") for p in PACK_COUNTS]
    return F.coalesce(*(F.when(n > 1, n) for n in numbers))


def parse_factored(text: Column) -> Column:
    """Quantities with the pack kept apart: ``array<struct<value, pack_count, unit, dimension, source, idx>>``."""
    parts = []
    for raw, v, u, k in FACTORED:
        pattern = ci(raw)

        def one(m, pattern=pattern, v=v, u=u, k=k):
            unit = units.parse_unit(group(m.value, pattern, u))
            return F.struct(
                group(m.value, pattern, v).cast("double").alias("value"),
                group(m.value, pattern, k).cast("int").alias("pack_count"),
                unit.alias("unit"),
                units.dimension_of(unit).alias("dimension"),
                m.value.alias("source"),
                m.start.alias("idx"),
            )

        parts.append(F.transform(find_all(text, pattern), _unary(one)))
    valid = F.filter(F.concat(*parts), lambda x: x.unit.isNotNull() & (x.value > 0) & (x.pack_count > 1))
    key = lambda x: F.struct(x.value.alias("v"), x.pack_count.alias("k"), x.unit.alias("u"))
    return _first_of_equal(valid, key)


def dimension_preference(dimension: Column) -> Column:
    return F.when(dimension.isin("mass", "volume", "area"), 3).when(dimension == "length", 2).otherwise(1)


def select_quantity(quantities: Column, preferred: Column | None = None) -> Column:
    """The quantity that says most: by dimension, then rank, then value; ties to the first."""
    other = F.lit(0) if preferred is None else None

    def ordered(q, i):
        apart = other if other is not None else F.when(q.dimension == preferred, 0).otherwise(1)
        keys = (apart.alias("o"), (-dimension_preference(q.dimension)).alias("d"), (-q["rank"]).alias("r"), (-q.value).alias("v"))
        return F.struct(*keys, i.alias("i"), q.alias("q"))

    return F.try_element_at(F.array_sort(F.transform(quantities, ordered)), F.lit(1)).q


def format_price(cents: Column, unit: Column) -> Column:
    """Shown unit price: cents to one or two decimals without trailing zeros, dollars from 100 cents on."""
    small = trim_zeros(F.when(cents >= 10, to_fixed(cents, 1)).otherwise(to_fixed(cents, 2)))
    label = units.label_of(unit)
    return F.when(cents < 100, F.concat(small, F.lit("¢/"), label)).otherwise(F.concat(F.lit("$"), to_fixed(cents / 100, 2), F.lit("/"), label))


def _plural(value: Column, word: str) -> Column:
    return F.when(F.abs(value - 1) < 0.0001, word).otherwise(word + "s")


def accessible_price(cents: Column, unit: Column) -> Column:
    """Spoken unit price, e.g. "5.5 cents per ounce"."""
    small = trim_zeros(F.when(cents >= 10, to_fixed(cents, 1)).otherwise(to_fixed(cents, 2)))
    whole = js_round(cents)
    dollars, rest = F.floor(whole / 100), F.pmod(whole, F.lit(100))
    big = F.concat_ws(" ", dollars, _plural(dollars, "dollar"))
    big = F.when(rest == 0, big).otherwise(F.concat_ws(" ", big, F.lit("and"), rest, _plural(rest, "cent")))
    amount = F.when(cents < 100, F.concat_ws(" ", small, _plural(cents, "cent"))).otherwise(big)
    return F.concat_ws(" ", amount, F.lit("per"), units.spoken_name(unit))


def any_of(text: Column, *patterns: str) -> Column:
    """Whether one of the patterns stands in the text, ignoring case."""
    return reduce(lambda a, b: a | b, [matches(text, p) for p in patterns])


#: Fixed value: what a control that chooses a pack says.
PACK_CONTROL = r"^(?:single\b|\d{1,3}\s*(?:-\s*)?(?:pack|pk)\b|(?:pack|pk)\s+of\s+\d{1,3}\b)"


def card_pack_count(title: Column, text: Column, controls: Column) -> Column:
    """Items in the pack that a card offers: of its title, else of the chosen one of its pack controls, else of its text.

    ``controls`` is an array of ``text, chosen``. Where packs can be chosen and none is, the count is unknown, whatever the text says.
    """
    packs = F.filter(controls, lambda c: matches(c["text"], PACK_CONTROL))
    some = F.exists(packs, lambda c: matches(c["text"], "(?:pack|pk)"))
    chosen = F.get(F.filter(packs, lambda c: c["chosen"]), F.lit(0))["text"]
    return F.coalesce(pack_count(title), F.when(F.coalesce(some, F.lit(False)), pack_count(chosen)).otherwise(pack_count(text)))

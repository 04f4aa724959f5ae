"""Units of measure: the dimension table, alias lookup, comparability and conversion."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import squeeze

# Unit, dimension, label, factor to the dimension's base unit, aliases.
UNITS = (
    ("oz", "mass", "oz", 1.0, ("oz", "oz.", "ounce", "ounces")),
    ("lb", "mass", "lb", 16.0, ("lb", "lb.", "lbs", "lbs.", "pound", "pounds")),
    ("g", "mass", "g", 0.03527396195, ("g", "gram", "grams")),
    ("kg", "mass", "kg", 35.27396195, ("kg", "kilogram", "kilograms")),
    ("fl_oz", "volume", "fl oz", 1.0, ("fl oz", "fl. oz", "fl. oz.", "fluid ounce", "fluid ounces", "floz")),
    ("ml", "volume", "mL", 0.0338140227, ("ml", "milliliter", "milliliters", "millilitre", "millilitres")),
    ("l", "volume", "L", 33.8140227, ("l", "liter", "liters", "litre", "litres")),
    ("gal", "volume", "gal", 128.0, ("gal", "gallon", "gallons")),
    ("qt", "volume", "qt", 32.0, ("qt", "quart", "quarts")),
    ("pt", "volume", "pt", 16.0, ("pt", "pint", "pints")),
    ("cup", "volume", "cup", 8.0, ("cup", "cups")),
    ("each", "count", "count", 1.0, ("ct", "ct.", "count", "counts", "each", "ea", "piece", "pieces", "item", "items")),
    ("roll", "count", "roll", 1.0, ("roll", "rolls")),
    ("sheet", "count", "sheet", 1.0, ("sheet", "sheets")),
    ("load", "count", "load", 1.0, ("load", "loads")),
    ("pod", "count", "pod", 1.0, ("pod", "pods", "pac", "pacs")),
    ("tablet", "count", "tablet", 1.0, ("tablet", "tablets", "tab", "tabs")),
    ("capsule", "count", "capsule", 1.0, ("capsule", "capsules", "cap", "caps")),
    ("diaper", "count", "diaper", 1.0, ("diaper", "diapers")),
    ("bag", "count", "bag", 1.0, ("bag", "bags")),
    ("sq_ft", "area", "sq ft", 1.0, ("sq ft", "sq. ft", "sq. ft.", "sqft", "square foot", "square feet", "ft2", "ft^2")),
    ("sq_in", "area", "sq in", 1 / 144, ("sq in", "sq. in", "sq. in.", "square inch", "square inches", "in2", "in^2")),
    ("yd", "length", "yd", 3.0, ("yd", "yd.", "yds", "yds.", "yard", "yards")),
    ("ft", "length", "ft", 1.0, ("ft", "ft.", "foot", "feet")),
    ("in", "length", "in", 1 / 12, ("in", "in.", "inch", "inches")),
)
# Preferred unit by dimension, what a preference may be, spoken names.
PREFERRED = {"mass": "lb", "volume": "fl_oz", "count": "each", "area": "sq_ft", "length": "ft"}
ALLOWED_PREFERENCES = {
    "mass": ("lb", "oz", "kg", "g"),
    "volume": ("fl_oz", "l", "ml", "gal"),
    "count": ("each",),
    "area": ("sq_ft", "sq_in"),
    "length": ("ft", "in"),
}
SPOKEN = {
    "oz": "ounce", "lb": "pound", "g": "gram", "kg": "kilogram", "fl_oz": "fluid ounce", "ml": "milliliter", "l": "liter",
    "gal": "gallon", "qt": "quart", "pt": "pint", "cup": "cup", "each": "item", "roll": "roll", "sheet": "sheet", "load": "load",
    "pod": "pod", "tablet": "tablet", "capsule": "capsule", "diaper": "diaper", "bag": "bag", "sq_ft": "square foot",
    "sq_in": "square inch", "yd": "yard", "ft": "foot", "in": "inch",
}

_ESCAPED = str.maketrans({c: "\\" + c for c in ".^$*+?()[]{}|"})


def units_table(spark: SparkSession) -> DataFrame:
    """The dimension table: 25 rows, so it may be broadcast."""
    rows = [(u, d, label, list(aliases), f) for u, d, label, f, aliases in UNITS]
    return spark.createDataFrame(rows, "unit string, dimension string, label string, aliases array<string>, to_base double")


def unit_pattern() -> str:
    """Alternation of all labels and aliases, longest first, for use inside a larger pattern."""
    names = dict.fromkeys(chain.from_iterable((label, *aliases) for _, _, label, _, aliases in UNITS))
    ordered = sorted(names, key=len, reverse=True)
    return "|".join(n.translate(_ESCAPED).replace(" ", r"\s+") for n in ordered)


def _lookup(pairs: dict, key: Column) -> Column:
    """The value of ``key`` in a fixed table, as text; one literal, which the optimizer folds into a map."""
    return F.try_element_at(F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in pairs.items())), F.lit("\x02"), F.lit("\x01")), key)


def normalize_unit_token(raw: Column) -> Column:
    """Lower-case spelling with one form for fluid ounces and squares, no brackets."""
    c = F.lower(raw)
    for pattern, to in ((r"fluid\s+ounces?", "fl oz"), (r"fl\.\s*oz\.?", "fl oz"), (r"sq\.\s*", "sq "), (r"\s+", " "), (r"[()]", "")):
        c = F.regexp_replace(c, pattern, to)
    return F.trim(c)


def _names() -> dict[str, str]:
    """Unit by normalised spelling; a later unit wins, as in a table filled in order."""
    import re

    out = {}
    for unit, _, label, _, aliases in UNITS:
        for name in (unit, label, *aliases):
            key = re.sub(r"fl\.\s*oz\.?", "fl oz", re.sub(r"fluid\s+ounces?", "fl oz", name.lower()))
            out[re.sub(r"sq\.\s*", "sq ", key).strip()] = unit
    return out


def parse_unit(raw: Column) -> Column:
    """Canonical unit of a spelling; null if unknown."""
    return _lookup(_names(), normalize_unit_token(raw))


def dimension_of(unit: Column) -> Column:
    return _lookup({u: d for u, d, *_ in UNITS}, unit)


def label_of(unit: Column) -> Column:
    return _lookup({u: label for u, _, label, *_ in UNITS}, unit)


def spoken_name(unit: Column) -> Column:
    return _lookup(SPOKEN, unit)


def to_base(unit: Column) -> Column:
    return _lookup({u: f for u, _, _, f, _ in UNITS}, unit).cast("double")


def units_are_comparable(left: Column, right: Column) -> Column:
    """Same dimension; counted units only with themselves."""
    return (dimension_of(left) == dimension_of(right)) & ((dimension_of(left) != "count") | (left == right))


def convert_price(cents: Column, source: Column, target: Column) -> Column:
    """Price per ``source`` unit as price per ``target`` unit; null if not comparable."""
    return F.when(units_are_comparable(source, target), cents / to_base(source) * to_base(target))


def quantity_to_base(value: Column, unit: Column) -> Column:
    return value * to_base(unit)


def default_unit(dimension: Column) -> Column:
    return _lookup(PREFERRED, dimension)


def merge_preferences(given: dict | None) -> dict:
    """Preferences with unknown or invalid entries replaced by the defaults."""
    given = given if isinstance(given, dict) else {}
    units = given.get("preferred_units")
    units = units if isinstance(units, dict) else {}
    flag = lambda name, default: given[name] if isinstance(given.get(name), bool) else default
    return {
        "enabled": flag("enabled", True),
        "include_rewards": flag("include_rewards", False),
        "show_lowest_signal": flag("show_lowest_signal", True),
        "preferred_units": {d: units[d] if units.get(d) in ok else PREFERRED[d] for d, ok in ALLOWED_PREFERENCES.items()},
    }


def target_unit(unit: Column, preferences: dict | None = None) -> Column:
    """The preferred unit of the dimension if comparable, else the unit itself."""
    wanted = _lookup(merge_preferences(preferences)["preferred_units"], dimension_of(unit))
    return F.when(units_are_comparable(unit, wanted), wanted).otherwise(unit)


def compare_key(unit: Column) -> Column:
    return F.concat_ws(":", dimension_of(unit), unit)


def clean_unit(raw: Column) -> Column:
    return parse_unit(squeeze(raw))

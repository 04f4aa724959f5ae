"""From parsed facts to one comparable unit price per product, or to none when the evidence conflicts."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, prices, units
from ..functions.text import matches, number_text, plain_space, to_fixed, trim_zeros

#: Largest relative difference at which a printed and a computed rate agree.
AGREEMENT = 0.08
#: Up to so many distinct keys Spark may broadcast what is computed from them; up to so many characters in all it must.
FEW, SHORT = 20_000, 4_000_000


def rates_agree(left: Column, right: Column) -> Column:
    return F.coalesce(F.try_divide(F.abs(left - right), left) <= AGREEMENT, F.lit(False))


def is_use_count(title: Column, q: Column) -> Column:
    """Whether a count is of things the product is used by, one at a time."""
    sheets = (q["unit"] == "sheet") & matches(title, classify.SEMANTIC_SHEETS)
    return (q["dimension"] == "count") & (q["unit"].isin("pod", "tablet", "capsule", "diaper") | sheets)


def _count_label(unit: Column) -> Column:
    # How a title may name the counted unit.
    names = {"pod": "pods?|pacs?|flings?", "tablet": "tablets?", "capsule": "capsules?", "diaper": "diapers?", "sheet": "sheets?"}
    out = F.lit(r"(?:ct\.?|counts?)")
    for name, words in names.items():
        out = F.when(unit == name, rf"(?:ct\.?|counts?|{words})").otherwise(out)
    return out


def pack_multiplier(title: Column, q: Column, pack_count: Column) -> Column:
    """How often the quantity stands in the package; null if the title leaves that open.

    The patterns hold the row's own number, so they are compiled per row, but only for packs.
    """
    n, value = F.coalesce(pack_count, F.lit(1)), number_text(q["value"])
    value, label = F.regexp_replace(value, r"\.", r"\\."), _count_label(q["unit"])
    edge = F.lit(r"(?<!\w)")
    end = F.lit(r"(?!\w)")
    both = F.concat(value, F.lit(r"\s*"), label)
    total = F.concat(
        F.lit(r"(?i)(?:(?<!\w)total(?:\s+of)?\s+"), both, end, F.lit("|"), edge, both, F.lit(r"\s+total"), end, F.lit("|"), edge, value,
        F.lit(r"\s+total\s+"), label, end, F.lit(")"),
    )
    each = F.concat(F.lit("(?i)"), edge, both, F.lit(r"\s*(?:per|in\s+each)\s+(?:pack|pk)"), end)
    bracket = F.concat(F.lit(r"(?i)\(\s*"), value, F.lit(r"(?:\.0+)?\s*(?:ct\.?|count)\s*\)"))
    number = n.cast("string")
    in_source = (
        F.rlike(q["source"], F.concat(F.lit("(?i)"), edge, number, F.lit(r"\s*(?:pack|pk)"), end))
        | F.rlike(q["source"], F.concat(F.lit(r"(?i)(?<!\w)(?:pack|pk)\s+of\s+"), number, end))
        | matches(q["source"], r"\b\d{2,6}\s*/\s*(?:cs|case|pk|pack)\b")
    )
    use, count = is_use_count(title, q), q["dimension"] == "count"
    return (
        F.when((n <= 1) | (q["dimension"] == "area"), 1)
        .when(use & F.rlike(title, total), 1)
        .when(use & F.rlike(title, each), n)
        .when(~use & count & (q["value"] == n), 1)
        .when(~use & count & F.rlike(title, bracket), 1)
        .when(in_source, 1)
        .when(use, F.lit(None))
        .otherwise(n)
        .cast("int")
    )


def checkpointed(df: DataFrame) -> DataFrame:
    """``df``, computed and written to the folder of ``spark.checkpoint.dir``; on a single machine a temporary one where that is unset."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="faircart-"))
    return df.checkpoint()


def per_distinct(rows: DataFrame, keys: list[str], add) -> DataFrame:
    """``rows`` with the columns that ``add(df)`` computes from ``keys`` alone, once for each distinct combination.

    Texts of offers repeat (one title for many dates and shops), and rules over texts cost far more than
    rows do. Distinct keys are gathered map-side first; adaptive execution splits a hot key in the join back. What is computed
    is checkpointed: else each further call would double the plan, and with it the scans of the input.
    """
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = checkpointed(add(rows.select(*keys).distinct().repartition(spread, *keys)))
    made = [c for c in known.columns if c not in keys]
    known = known.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), *made)
    # A checkpoint is judged by the size of the files it came from, however much was made of them.
    size = F.sum(F.length(F.concat_ws("", *(F.col(f"_key{i}").cast("string") for i in range(len(keys))))))
    count, chars = known.limit(FEW + 1).agg(F.count("*"), F.coalesce(size, F.lit(0))).first()
    if count > FEW:
        rows, known = rows.hint("merge"), known.hint("merge")
    elif chars <= SHORT:
        # Few short keys: the rows need no shuffle, which would put all of a frequent key together.
        known = known.hint("broadcast")
    same = reduce(lambda x, y: x & y, [rows[k].eqNullSafe(known[f"_key{i}"]) for i, k in enumerate(keys)])
    return rows.join(known, same, "left").drop(*(f"_key{i}" for i in range(len(keys))))


def _rate(cents: Column, unit: Column, dimension: Column) -> Column:
    return F.struct(cents.alias("cents"), unit.alias("unit"), dimension.alias("dimension"))


def _price(rate: Column, explanation: Column, source: str) -> Column:
    """A rate with what is shown of it."""
    return F.struct(
        rate["cents"].alias("cents"),
        rate["unit"].alias("unit"),
        rate["dimension"].alias("dimension"),
        prices.format_price(rate["cents"], rate["unit"]).alias("display"),
        F.concat_ws(":", rate["dimension"], rate["unit"]).alias("compare_key"),
        explanation.alias("explanation"),
        F.lit(source).alias("source"),
    )


def native_price(native: Column, rate: Column) -> Column:
    told = F.when(native["unit"] == rate["unit"], F.concat(F.lit("Visible unit price "), native["source"])).otherwise(
        F.concat(F.lit("Converted "), native["source"], F.lit(" to "), units.label_of(rate["unit"]))
    )
    return _price(rate, told, "native-unit-price")


def package_price(price_cents: Column, q: Column, times: Column, rate: Column) -> Column:
    amount = trim_zeros(number_text(q["value"] * times))
    told = F.concat(F.lit("$"), to_fixed(price_cents / 100, 2), F.lit(" / "), amount, F.lit(" "), units.label_of(q["unit"]))
    return _price(rate, told, "current-price")


# The texts of warnings.
def warnings(title: Column, pack_count: Column, source: Column, target: Column) -> Column:
    found = F.array(
        F.when(pack_count > 1, F.concat(F.lit("Multi-pack detected: "), pack_count, F.lit(" pack."))),
        F.when(source != target, F.concat(F.lit("Converted from "), units.label_of(source), F.lit("."))),
        F.when(title.rlike("(?i)lightweight|concentrated|mega|ultra|double roll"), "Product terms may affect real-world value beyond unit price."),
    )
    return F.array_compact(found)


#: What the rules over titles read of a product; see ``title_verdicts``.
VERDICT_KEYS = ["title", "_nu", "_nd", "_ns", "_pv", "_pu", "_pd", "_ps", "pack_count"]


def title_verdicts(keys: DataFrame, preferences: dict | None = None) -> DataFrame:
    """All decisions that need a pattern or a table: on the package, the printed price, the pack, the family and the units."""
    title, fields = F.col("title"), ("value", "unit", "dimension", "source")
    package = F.when(F.col("_pu").isNotNull(), F.struct(*(F.col(c).alias(f) for c, f in zip(("_pv", "_pu", "_pd", "_ps"), fields, strict=True))))
    rows = keys.withColumn("_package", package).withColumn("_ok", classify.is_likely(title, F.col("_package")))
    rows = rows.withColumn("_times", F.when(F.col("_package").isNotNull(), pack_multiplier(title, F.col("_package"), F.col("pack_count"))))
    refused = classify.rejection_reason(title, F.col("_nd"), F.col("_nu"), F.lit(None).cast("double"), F.col("_ns")).isNotNull()
    rows = rows.withColumn("_refused", F.when(F.col("_nu").isNotNull(), refused))
    rows = rows.withColumn("_counted", matches(F.col("_ps"), r"\b(?:ct\.?|counts?|pieces?|items?)\b"))
    rows = rows.withColumn("_cased", F.col("_ps").rlike(r"(?i)/\s*case|pack"))
    liquid = F.when(F.col("_pd") == "volume", classify.family(title, F.col("_pd")) == "laundry:detergent-liquid")
    for side in "np":
        unit, to = F.col(f"_{side}u"), F.col(f"_{side}to")
        rows = rows.withColumn(f"_{side}to", units.target_unit(unit, preferences)).withColumn(f"_{side}from", units.to_base(unit))
        rows = rows.withColumn(f"_{side}into", F.when(units.units_are_comparable(unit, to), units.to_base(to)))
    return rows.withColumn("_liquid", liquid).drop("_package")


def normalize(products: DataFrame, preferences: dict | None = None) -> DataFrame:
    """Adds ``normalized`` (null where the evidence is missing or conflicts) and ``warnings``.

    ``products`` has title, price_cents, native ``struct<cents,unit,dimension,source,...>``, package
    ``struct<value,unit,dimension,source,...>`` and pack_count. Rules over texts run once for each distinct title with its
    parsed facts; what remains for a row is arithmetic. Columns that begin with ``_`` are kept free for this.
    """
    title, native, package = F.col("title"), F.col("native"), F.col("package")
    fluid = F.coalesce((native["unit"] == "oz") & (package["unit"] == "fl_oz"), F.lit(False))
    rows = products.withColumn("_fluid", fluid)
    rows = rows.withColumn("_nu", F.when(fluid, F.lit("fl_oz")).otherwise(native["unit"]))
    rows = rows.withColumn("_nd", F.when(fluid, F.lit("volume")).otherwise(native["dimension"]))
    # Only these kinds of printed prices are judged by their own text.
    rows = rows.withColumn("_ns", F.when(F.col("_nd").isin("length", "count") | (F.col("_nu") == "g"), native["source"]))
    rows = rows.select("*", package["value"].alias("_pv"), package["unit"].alias("_pu"), package["dimension"].alias("_pd"), package["source"].alias("_ps"))
    rows = per_distinct(rows, VERDICT_KEYS, lambda keys: title_verdicts(keys, preferences))
    own = F.struct(native["cents"].alias("cents"), F.col("_nu").alias("unit"), F.col("_nd").alias("dimension"), native["source"].alias("source"))
    count = (native["unit"] == "each") & (F.col("_pd") == "count") & (F.col("_pv") > 1)
    usable = native.isNotNull() & (~F.col("_refused") | F.coalesce(count & F.col("_ok"), F.lit(False)))
    packed = F.col("_ok") & F.col("price_cents").isNotNull() & F.col("_times").isNotNull()
    # Small expressions: a filter on the choice repeats them wherever the choice reads them.
    rate = native["cents"] / F.col("_nfrom") * F.col("_ninto")
    rows = rows.withColumn("_n", F.when(usable & F.col("_ninto").isNotNull(), _rate(rate, F.col("_nto"), F.col("_nd"))))
    base = F.col("_pv") * F.col("_times") * F.col("_pfrom")
    rows = rows.withColumn("_p", F.when(packed & (base > 0) & F.col("_pinto").isNotNull(), _rate(F.col("price_cents") / base * F.col("_pinto"), F.col("_pto"), F.col("_pd"))))
    n, p = F.col("_n"), F.col("_p")
    counted = (F.col("_pd") == "count") & (F.col("_pv") > 1) & F.col("_counted")
    takes_package = (n["unit"] == "each") & (counted | (p["dimension"] != "count") | (p["unit"] != "each") | F.col("_cased"))
    other = (p["dimension"] == "count") & (p["unit"] != "each")
    liquid = (p["dimension"] == "volume") & F.col("_liquid")
    choice = (
        F.when(package.isNotNull() & F.col("_times").isNull() & n.isNotNull() & (n["dimension"] != "count"), "abstain")
        .when(n.isNull() & p.isNull(), "abstain")
        .when(n.isNull(), "package")
        .when(p.isNull(), "native")
        .when(F.coalesce(takes_package, F.lit(False)), "package")
        .when(F.col("_fluid"), F.when(rates_agree(native["cents"], p["cents"]), "package").otherwise("abstain"))
        .when(n["dimension"] != p["dimension"], F.when(other | F.coalesce(liquid, F.lit(False)), "package").otherwise("native"))
        .when(rates_agree(n["cents"], p["cents"]), "native")
        .otherwise("abstain")
    )
    rows = rows.withColumn("choice", choice)
    by_native, by_package = F.col("choice") == "native", F.col("choice") == "package"
    picked = F.when(by_native, native_price(own, n)).when(by_package, package_price(F.col("price_cents"), package, F.col("_times"), p))
    unit, target = F.when(by_native, F.col("_nu")).when(by_package, F.col("_pu")), F.when(by_native, n["unit"]).when(by_package, p["unit"])
    told = F.when(by_native | by_package, warnings(title, F.col("pack_count"), unit, target))
    return rows.select(*(F.col(c) for c in products.columns), "choice", picked.alias("normalized"), told.alias("warnings"))


def usable_quantities(title: Column, text: Column) -> Column:
    """The quantities of ``text`` that may be the package size of a product with this title."""
    own = F.transform(prices.parse_quantities(text), lambda q: classify.specialize(title, q))
    return F.filter(own, lambda q: classify.reject(title, q).isNull())


def title_facts(titles: DataFrame) -> DataFrame:
    """What a title alone tells: printed price, quantities, the quantity a product is used by, pack count."""
    title = F.col("title")
    rows = titles.withColumn("_title_native", F.try_element_at(prices.parse_native_prices(title), F.lit(1)))
    rows = rows.withColumn("_in_title", usable_quantities(title, title))
    rows = rows.withColumn("_title_use", classify.select_use_quantity(title, F.col("_in_title")))
    return rows.withColumn("_title_pack", prices.pack_count(title))


def text_facts(texts: DataFrame) -> DataFrame:
    """What the text of a card and the part of it with prices tell by themselves: printed price, current price, pack count."""
    text, scoped = F.col("_text"), F.col("_scoped")
    rows = texts.withColumn("_shown", F.try_element_at(prices.parse_native_prices(text), F.lit(1)))
    best = F.coalesce(prices.best_price(scoped), F.when(scoped != text, prices.best_price(text)))
    return rows.withColumn("_text_price", best["cents"]).withColumn("_text_pack", prices.pack_count(text))


#: All that the facts of an offer come from, and what they are.
OFFER_KEYS = ["title", "_text", "_scoped"]
OFFER_FACTS = ["native", "package", "price_cents", "pack_count", "choice", "normalized", "warnings"]


def offer_facts(offers: DataFrame, preferences: dict | None = None) -> DataFrame:
    """``OFFER_FACTS`` of distinct ``OFFER_KEYS``; titles and texts are each read once."""
    rows = per_distinct(per_distinct(checkpointed(offers), ["title"], title_facts), ["_text", "_scoped"], text_facts)
    title, none = F.col("title"), F.size("_in_title") == 0
    rows = rows.withColumn("native", F.coalesce("_title_native", "_shown"))
    elsewhere = F.when(none & F.col("_title_native").isNull(), usable_quantities(title, F.col("_text")))
    rows = rows.withColumn("_quantities", F.coalesce(elsewhere, "_in_title"))
    wanted = F.when(F.col("native.unit") != "each", F.col("native.dimension"))
    use = F.when(none, classify.select_use_quantity(title, F.col("_quantities"))).otherwise(F.col("_title_use"))
    rows = rows.withColumn("_chosen", F.coalesce(use, prices.select_quantity(F.col("_quantities"), wanted)))
    q = F.col("_chosen")
    rank = F.when(F.contains(title, q["source"]), F.greatest(q["rank"], F.lit(3))).otherwise(q["rank"])
    raised = F.when(q.isNotNull(), F.struct(*((rank if c == "rank" else q[c]).alias(c) for c in classify.QUANTITY_FIELDS)))
    rows = rows.withColumn("package", raised)
    rows = rows.withColumn("price_cents", F.col("_text_price")).withColumn("pack_count", F.coalesce("_title_pack", "_text_pack"))
    # The verdicts read the rows twice: to gather their keys and to join back.
    rows = checkpointed(rows.select(*OFFER_KEYS, "native", "package", "price_cents", "pack_count"))
    return normalize(rows, preferences)


def extract(cards: DataFrame, preferences: dict | None = None) -> DataFrame:
    """Products of ``cards(title, card_text, price_text)`` that could be normalised; other columns stay.

    Facts come from the title first, then from the text. A quantity that stands in the title outranks others. All of them, prices
    and their displays too, are made once for each distinct offer; a row is only joined with them.
    """
    text, scoped = plain_space(F.coalesce("card_text", F.lit(""))), plain_space(F.coalesce("price_text", "card_text", F.lit("")))
    rows = cards.drop(*OFFER_FACTS).withColumn("title", plain_space(F.col("title"))).withColumn("_text", text).withColumn("_scoped", scoped)
    rows = per_distinct(rows, OFFER_KEYS, lambda offers: offer_facts(offers, preferences))
    return rows.drop("_text", "_scoped").where("choice <> 'abstain'")


def matching_native(native: Column, package: Column, normalized: Column) -> Column:
    """Whether the printed price already shows what would be displayed."""
    unit = F.when((native["unit"] == "oz") & (package["unit"] == "fl_oz"), "fl_oz").otherwise(native["unit"])
    dimension = F.when(unit == "fl_oz", "volume").otherwise(native["dimension"])
    same = (dimension == normalized["dimension"]) & (unit == normalized["unit"])
    return F.coalesce(same & (prices.format_price(native["cents"], unit) == normalized["display"]), F.lit(False))


#: What the rules of an audit read of a product; see ``audit_verdicts``.
AUDIT_KEYS = ["title", "_nu", "_nd", "_ns", "_pv", "_pu", "_pd", "_ps"]


def audit_verdicts(keys: DataFrame) -> DataFrame:
    """Why a printed price and a package can't be of a product with this title, and whether it is none."""
    title, fields = F.col("title"), ("value", "unit", "dimension", "source")
    rate, package = (F.struct(*(c.alias(f) for c, f in zip((value, *(F.col(f"_{side}{x}") for x in "uds")), fields, strict=True))) for side, value in (("n", F.lit(None).cast("double")), ("p", F.col("_pv"))))
    rows = keys.withColumn("_on_native", classify.reject(title, rate)).withColumn("_on_package", classify.reject(title, package))
    return rows.withColumn("_no_product", classify.is_non_product_title(title))


def audit(products: DataFrame, target: Column | None = None) -> DataFrame:
    """One row per finding on normalised products: all columns and ``finding<reason, severity>``.

    Rules over texts run once for each distinct title with its facts. Columns that begin with ``_`` are kept free for this.
    """
    native, package, n = (F.col(c) for c in ("native", "package", "normalized"))
    finding = lambda when, reason, severity: F.when(when, F.struct(reason.alias("reason"), F.lit(severity).alias("severity")))
    facts = [native[f].alias(f"_n{f[0]}") for f in ("unit", "dimension", "source")] + [package[f].alias(f"_p{f[0]}") for f in ("value", "unit", "dimension", "source")]
    rows = products.select("*", F.lit(None).cast("string").alias("_target") if target is None else target.alias("_target"), *facts)
    rows = per_distinct(rows, AUDIT_KEYS, audit_verdicts)
    on_native, on_package = F.col("_on_native"), F.col("_on_package")
    count = (native["unit"] == "each") & (package["dimension"] == "count") & (package["value"] > 1) & on_package.isNull()
    suffix = lambda c: F.regexp_replace(c, "-as-(quantity|unit)$", "")
    checks = [
        finding(F.col("_no_product"), F.lit("non-product-title"), "error"),
        finding(
            native.isNotNull() & (n["source"] == "native-unit-price") & on_native.isNotNull() & ~F.coalesce(count, F.lit(False)),
            F.concat(F.lit("native-"), suffix(on_native)),
            "error",
        ),
        finding(package.isNotNull() & (n["source"] == "current-price") & on_package.isNotNull(), F.concat(F.lit("package-"), suffix(on_package)), "error"),
        finding(
            n.isNotNull() & native.isNull() & ~(F.col("price_cents").isNotNull() & package.isNotNull()), F.lit("normalized-source-missing"), "error"
        ),
        finding((n["dimension"] == "count") & (n["cents"] < 0.1), F.lit("implausibly-low-count-price"), "review"),
    ]
    if target is not None:
        checks.append(finding(F.col("_target").isNotNull() & (n["dimension"] != F.col("_target")), F.lit("target-dimension-mismatch"), "info"))
    return rows.select(*(F.col(c) for c in products.columns), F.explode(F.array_compact(F.array(*checks))).alias("finding"))

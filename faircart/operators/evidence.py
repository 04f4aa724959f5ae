"""Evidence of product cards: candidates by id, model answers resolved against them, and annotations without a model.

Nodes are those of ``observation``; a card is one of them, and its evidence is what stands in it or below. Node ``5`` is called
``n5`` in answers, and its candidates ``n5@p0`` (prices), ``n5@u0`` (unit prices), ``n5@q0`` (quantities) and ``n5@k0`` (pack counts).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify, grammar, prices, units
from ..functions.text import base36, ci, find_all, matches, squeeze
from . import normalize, validate
from .tree import PAGE, sorted_join

CARD = [PAGE, "card"]

# What speaks for and against an amount as the current price, within 40 characters before and 50 after.
PRICE_NOW = r"\b(?:current price|now|sale price|you pay)\b"
PRICE_OTHER = r"\b(?:was|list|reg\.?|regular|save|coupon|more buying choices|free delivery|orders? over)\b"
PRICE_RATE = r"(?:/|\bper\s+)\s*(?:oz|lb|kg|g|ml|l|ct|count|ea|each|sq\s*ft)\b"
#: Words of a size in a title; sizes that are measures of a thing; rates for one piece.
SIZE_WORD = r"\b(?:oz|lb|ct|count|pack|roll|sheet|ml|liter|sq\s*ft)\b"
MEASURES = r"\d+(?:\.\d+)?\s*[x×]\s*\d+(?:\.\d+)?(?:\s*[x×]\s*\d+(?:\.\d+)?)?\s*(?:inch(?:es)?|in\.?)(?=\W|$)"
PER_PIECE = r"(?:/|\bper\s+)\s*(?:ea|each)\b"
#: Largest divergence of a price from what rate and quantity give; lead of one price over the next.
DIVERGENCE, LEAD = 0.2, 8


def own_strings() -> Column:
    """A node's own texts, without blank ones."""
    return F.filter(F.array("text", "label"), lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")


def card_texts(nodes: DataFrame, cards: DataFrame) -> DataFrame:
    """``(page_id, card, node, tag, own, parts, descendants)`` of every node of ``cards(page_id, card)``.

    ``parts`` are the strings of the node and all below it in document order. A card's subtree lies on one page.
    """
    rows = sorted_join(nodes.select(PAGE, "node", "tag", "path", own_strings().alias("own")), cards.select(*CARD).distinct(), PAGE).where("array_contains(path, card)")
    up = rows.select(*CARD, "node", "tag", "own", F.explode(F.expr("slice(path, cast(array_position(path, card) as int), size(path))")).alias("top"))
    itself = F.max(F.when(F.col("node") == F.col("top"), F.struct("tag", "own")))
    parts = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("node", "own"))), lambda x: x["own"]))
    found = up.groupBy(*CARD, "top").agg(itself.alias("self"), parts.alias("parts"), (F.count("*") - 1).alias("descendants"))
    return found.select(*CARD, F.col("top").alias("node"), "self.tag", "self.own", "parts", "descendants")


def joined(parts: Column) -> Column:
    return squeeze(F.array_join(parts, " "))


def candidate_facts(texts: DataFrame) -> DataFrame:
    """``found``: the candidates that ``text`` holds, numbered by kind, the first of equal ones each."""
    text = F.col("text")
    factored = prices.parse_factored(text)
    none = {"cents": F.lit(None).cast("double"), "unit": F.lit(None).cast("string"), "dimension": F.lit(None).cast("string"), "value": F.lit(None).cast("double"), "packs": F.lit(None).cast("int")}

    def own(kind, items, **values):
        def one(x):
            held = {k: x[values[k]].cast("double") if k in ("cents", "value") else x[values[k]] for k in values}
            return F.struct(F.lit(kind).alias("kind"), x["source"].alias("source"), *((held.get(k, v)).alias(k) for k, v in none.items()))

        return F.transform(items, one)

    def numbered(items):
        names = ("source", *none)
        return F.transform(F.array_distinct(items), lambda x, i: F.struct(x["kind"].alias("kind"), i.alias("i"), *(x[n].alias(n) for n in names)))

    pack = F.struct(prices.pack_count(text).alias("n"), text.alias("source"))
    alone = F.filter(F.array(pack), lambda x: x["n"].isNotNull())
    every = (
        own("p", prices.parse_money(text), cents="cents"),
        own("u", prices.parse_native_prices(text), cents="cents", unit="unit", dimension="dimension"),
        F.concat(own("q", factored, value="value", unit="unit", dimension="dimension"), own("q", prices.parse_quantities(text), value="value", unit="unit", dimension="dimension")),
        F.concat(own("k", factored, packs="pack_count"), own("k", alone, packs="n")),
    )
    return texts.withColumn("found", F.concat(*(numbered(x) for x in every)))


def direct_facts(texts: DataFrame) -> DataFrame:
    """Amounts and unit labels of nodes that print no unit price themselves."""
    text = F.col("direct")
    plain = F.size(prices.parse_native_prices(text)) == 0
    money = F.array_distinct(F.transform(prices.parse_money(text), lambda m: F.struct(m["cents"].alias("cents"), m["source"].alias("source"))))
    labels = F.filter(prices.parse_per_unit(text), lambda x: x["dimension"].isin("area", "length"))
    labels = F.array_distinct(F.transform(labels, lambda x: F.struct(x["unit"].alias("unit"), x["dimension"].alias("dimension"), x["source"].alias("source"))))
    return texts.withColumn("money", F.when(plain, money)).withColumn("labels", F.when(plain, labels))


def candidates(nodes: DataFrame, cards: DataFrame) -> DataFrame:
    """``(page_id, card, id, kind, node, evidence, source, cents, unit, dimension, value, packs)``: what an answer may name.

    If a card's own texts hold one amount and, in other nodes, labels of one unit of area or length, both together are
    a unit price too, counted after the card's own.
    """
    texts = card_texts(nodes, cards).select(*CARD, "node", joined(F.col("parts")).alias("text"), joined(F.array_distinct("own")).alias("direct")).where("text <> ''")
    known = normalize.per_distinct(texts, ["text", "direct"], lambda t: direct_facts(candidate_facts(t)))
    # Amounts and labels of a card are few; both come to its row with the nodes they stand in.
    here = lambda c: F.transform(c, lambda x: F.struct(F.col("node").alias("node"), x.alias("x")))
    gather = lambda c: F.array_sort(F.flatten(F.collect_list(here(c))))
    apart = known.groupBy(*CARD).agg(
        F.flatten(F.collect_list(F.transform("found", lambda x: F.struct(F.col("node").alias("node"), x.alias("x"))))).alias("plain"), gather("money").alias("money"), gather("labels").alias("labels")
    )
    at, amount = F.col("money")[0]["node"], F.col("money")[0]["x"]
    fits = (F.size("money") == 1) & (F.size(F.array_distinct(F.transform("labels", lambda l: l["x"]["unit"]))) == 1)
    before = F.size(F.filter("plain", lambda p: (p["node"] == F.col("card")) & (p["x"]["kind"] == "u")))
    null = lambda kind: F.lit(None).cast(kind)
    row = lambda name, kind, node, cited, source, cents, unit, dimension, value, packs: F.struct(
        name.alias("id"), kind.alias("kind"), node.alias("node"), cited.alias("evidence"), source.alias("source"), cents.alias("cents"),
        unit.alias("unit"), dimension.alias("dimension"), value.alias("value"), packs.alias("packs"),
    )
    plain = F.transform("plain", lambda p: row(
        F.concat(F.lit("n"), p["node"], F.lit("@"), p["x"]["kind"], p["x"]["i"]), p["x"]["kind"], p["node"], F.array(p["node"]), *(p["x"][f] for f in ("source", "cents", "unit", "dimension", "value", "packs")),
    ))
    split = F.transform(F.filter("labels", lambda l: fits & (l["node"] != at)), lambda l, i: row(
        F.concat(F.lit("n"), F.col("card"), F.lit("@u"), before + i), F.lit("u"), F.col("card"), F.array(at, l["node"]), F.concat_ws(" ", amount["source"], l["x"]["source"]),
        amount["cents"].cast("double"), l["x"]["unit"], l["x"]["dimension"], null("double"), null("int"),
    ))
    return apart.select(*CARD, F.inline_outer(F.concat(plain, split))).where("id is not null")


def node_number(name: Column) -> Column:
    """5 for ``n5``; null for what names no node."""
    return F.regexp_extract(name, r"^n(\d+)$", 1).try_cast("int")


def resolve_pointers(answers: DataFrame, nodes: DataFrame, key: str = "answer_id") -> DataFrame:
    """``answers(key, page_id, answer)`` as products, or why not: one row each.

    Returns ``(key, page_id, state, issues, card, title, cents, native, quantity, packs)``. ``state`` is invalid, abstained or
    comparable. ``issues`` are those of the first step that fails: the form, the card, its title nodes, the title's text, or
    the candidates, each as ``FIELD:code``. A candidate may be unknown, stand outside the card, or be of another kind than its
    field. All references of an answer are rows, so nodes and candidates are joined by key whatever their number.
    """
    # The form is judged once for each distinct answer; a well-formed one is read by its lines.
    read = normalize.per_distinct(answers.select(key, PAGE, "answer"), ["answer"], lambda a: a.withColumn("form", grammar.pointer_issue(F.col("answer"), any_kind=True)))
    read = read.withColumn("f", F.transform(F.split("answer", "\n"), lambda line: F.regexp_replace(line, "^[A-Z_]+ ", "")))
    read = read.select(key, PAGE, "form", "f", F.when(F.col("form").isNull(), node_number(F.col("f")[0])).alias("card"), F.get("f", F.lit(6)).alias("status"))
    good = read.where("form is null")
    ref = lambda field, at, name: F.struct(F.lit(field).alias("field"), at.alias("at"), name.alias("name"))
    titles = F.transform(F.split(F.get("f", F.lit(1)), ","), lambda x, i: ref("TITLE", i, x))
    asked = F.array(*(ref(f, F.lit(i), F.get("f", F.lit(i + 2))) for i, f in enumerate(grammar.KINDS)))
    asked = F.filter(asked, lambda x: (F.col("status") == "comparable") & (x["name"] != "NONE"))
    refs = good.select(key, PAGE, "card", F.inline_outer(F.concat(F.array(ref("CARD", F.lit(0), F.get("f", F.lit(0)))), titles, asked)))
    refs = refs.withColumn("node", node_number(F.regexp_replace("name", "@[puqk][0-9]+$", "")))
    named = refs.where("field = 'TITLE'").select(key, PAGE, "at", F.col("node").alias("top"))
    refs = sorted_join(refs, nodes.select(PAGE, "node", "path"), [PAGE, "node"], "left")
    found = candidates(nodes, good.select(PAGE, "card").where("card is not null").distinct())
    found = found.select(*CARD, F.col("id").alias("name"), F.struct("kind", "evidence", "cents", "unit", "dimension", "value", "packs").alias("c"))
    refs = sorted_join(refs, found, [*CARD, "name"], "left")
    there, inside = F.col("path").isNotNull(), F.array_contains("path", F.col("card"))
    wanted = F.element_at(F.create_map(*(F.lit(x) for pair in grammar.KINDS.items() for x in pair)), F.col("field"))
    code = (
        F.when(F.col("field").isin("CARD", "TITLE") & ~there, "unknown-node")
        .when((F.col("field") == "TITLE") & ~inside, "evidence-outside-card")
        .when(~F.col("field").isin("CARD", "TITLE") & F.col("c").isNull(), F.when(there & ~inside, "evidence-outside-card").otherwise("unknown-candidate"))
        .when(F.col("c").isNotNull() & (F.col("c.kind") != wanted), "candidate-kind-mismatch")
    )
    stage = F.when(F.col("field") == "CARD", 0).when(F.col("field") == "TITLE", 1).otherwise(3)
    issue = F.when(code.isNotNull(), F.struct(stage.alias("stage"), "at", F.concat_ws(":", "field", code).alias("text")))
    value = lambda f: F.max(F.when((F.col("field") == f) & (F.col("c.kind") == grammar.KINDS[f]), F.col("c"))).alias(f)
    told = refs.groupBy(key).agg(F.array_sort(F.collect_list(issue)).alias("found"), *map(value, grammar.KINDS))
    # A title is the text of its nodes in the order named, each node once with all below it.
    below = nodes.select(PAGE, "node", own_strings().alias("own"), F.explode("path").alias("top"))
    parts = sorted_join(named, below, [PAGE, "top"]).groupBy(key, "node").agg(F.min("at").alias("at"), F.first("own").alias("own"))
    parts = parts.groupBy(key).agg(joined(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "node", "own"))), lambda x: x["own"]))).alias("title"))
    rows = sorted_join(sorted_join(read, told, key, "left"), parts, key, "left")
    first = F.array_min(F.transform("found", lambda x: x["stage"]))
    own = F.transform(F.filter("found", lambda x: x["stage"] == first), lambda x: x["text"])
    untitled = F.coalesce(F.col("title"), F.lit("")) == ""
    issues = (
        F.when(F.col("form").isNotNull(), F.array(F.concat(F.lit("OUTPUT:"), "form")))
        .when(first < 2, own)
        .when(untitled, F.array(F.lit("TITLE:missing-evidence")))
        .otherwise(F.coalesce(own, F.array().cast("array<string>")))
    )
    rows = rows.withColumn("issues", issues)
    valid = F.size("issues") == 0
    state = F.when(~valid, "invalid").when(F.col("status") == "comparable", "comparable").otherwise("abstained")
    only = lambda c: F.when(valid, c)
    native, quantity, pack = F.col("NATIVE_UNIT_PRICE"), F.col("PACKAGE_QUANTITY"), F.col("PACK_COUNT")
    pick = lambda c, *names: F.when(valid & c.isNotNull(), F.struct(*(c[n].alias(n) for n in names)))
    return rows.select(
        key, PAGE, state.alias("state"), "issues", "card", only(F.col("title")).alias("title"), only(F.col("CURRENT_PRICE.cents").cast("long")).alias("cents"),
        pick(native, "cents", "unit", "dimension", "evidence").alias("native"), pick(quantity, "value", "unit", "dimension", "evidence").alias("quantity"),
        only(F.when(quantity.isNotNull(), F.coalesce(pack["packs"], F.lit(1)))).alias("packs"),
    )


def price_context(text: Column, money: Column) -> Column:
    """How much the words around an amount speak for it as the current price."""
    start = F.greatest(money["idx"] - 40, F.lit(0))
    around = F.lower(F.substring(text, start + 1, money["idx"] + F.length(money["source"]) + 50 - start))
    one = lambda pattern, n: F.when(matches(around, pattern), n).otherwise(0)
    return one(PRICE_NOW, 8) + one(PRICE_OTHER, -8) + one(PRICE_RATE, -10)


def text_facts(texts: DataFrame) -> DataFrame:
    """Scored amounts, unit prices in order of preference, and unit labels of ``text``."""
    text = F.col("text")
    money = F.transform(prices.parse_money(text), lambda m: F.struct((-price_context(text, m)).alias("against"), m["cents"].alias("cents")))
    shown = squeeze(F.regexp_replace(F.regexp_replace(text, r"\(\s*/\s*", "/"), r"\s*\)", " "))
    rate = lambda m: F.struct(
        F.when(m["dimension"].isin("mass", "volume"), -3).when(m["dimension"].isin("area", "length"), -2).otherwise(-1).alias("order"),
        m["idx"].alias("idx"), m["cents"].alias("cents"), m["unit"].alias("unit"), m["dimension"].alias("dimension"),
    )
    native = F.array_min(F.transform(F.filter(prices.parse_native_prices(shown), lambda m: ~matches(m["source"], PER_PIECE)), rate))
    return texts.withColumn("money", money).withColumn("native", native).withColumn("labels", prices.parse_per_unit(text))


def title_score(tag: Column, labelled: Column, text: Column) -> Column:
    """How much a node's string looks like its card's title."""
    kind = F.when(tag.rlike("(?i)^h[1-6]$"), 120).when(tag == "a", 90).when((tag == "img") & labelled, 40).otherwise(0)
    return kind + F.when(matches(text, SIZE_WORD), 20).otherwise(0) + F.least(F.lit(20), F.size(F.split(text, r"\s+")))


def title_quantities(title: Column) -> Column:
    """The quantities of a title that aren't measures of a thing, as 3 x 4 inches."""
    spans = find_all(title, ci(MEASURES))
    free = lambda q: ~matches(q["source"], MEASURES) & ~F.exists(spans, lambda s: (q["idx"] >= s["start"]) & (q["idx"] < s["end"]))
    return F.filter(prices.parse_quantities(title), free)


def with_title_quantity(rows: DataFrame, title: str, dimension: Column, unit: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: ``struct<value, packs, unit, dimension>``, the package size that the title states.

    Of quantities of the given unit, else of the given dimension, the one that says most; null where none has the dimension.
    """
    found = normalize.per_distinct(rows, [title], lambda t: t.withColumn("_sizes", title_quantities(F.col(title))).withColumn("_packs", prices.pack_count(F.col(title))))
    exact = F.filter("_sizes", lambda q: F.coalesce(q["unit"] == unit, F.lit(False)))
    alike = F.filter("_sizes", lambda q: dimension.isNull() | (q["dimension"] == dimension))
    usable = F.when(dimension.isNotNull() & (F.size(alike) == 0), F.array().cast(prices.QUANTITY)).when(F.size(exact) > 0, exact).otherwise(alike)
    found = found.withColumn("_best", prices.select_quantity(usable))
    product = r"(?i)^(\d+(?:\.\d+)?)\s*(?:x|×|by)\s*(\d+(?:\.\d+)?)\s+"
    times = F.regexp_extract("_best.source", product, 1)
    value = F.when(times != "", F.regexp_extract("_best.source", product, 2).try_cast("double")).otherwise(F.col("_best.value"))
    packs = F.when(times != "", F.floor(times.try_cast("double")).cast("int")).otherwise(F.coalesce("_packs", F.lit(1)))
    size = F.struct(value.alias("value"), packs.alias("packs"), F.col("_best.unit").alias("unit"), F.col("_best.dimension").alias("dimension"))
    return found.withColumn(name, F.when(F.col("_best").isNotNull(), size)).drop("_sizes", "_packs", "_best")


def annotate(nodes: DataFrame, cards: DataFrame) -> DataFrame:
    """What a card says without a model: one row for each of ``cards(page_id, card, dimension)`` that has any text.

    Returns ``(page_id, card, method, title, title_node, price, native, quantity, abstain_reason, issues)``. ``dimension`` is the one the
    site compares by, or null. Title: the best-looking string, else (then it is no product) the shortest. Unit price: printed
    in the fewest nodes; for area and length also one amount whose unit stands in another node. Quantity: in the title. Price:
    the one that rate and quantity confirm, else the only or leading one. Without enough of these the card abstains.
    ``issues`` says what isn't found again in the evidence it cites. All picks are minima, so one aggregation makes them.
    """
    wanted = cards.select(*CARD, F.col("dimension").alias("target")).distinct()
    texts = card_texts(nodes, cards).withColumn("text", joined(F.array_distinct("parts")))
    strings = F.transform("own", lambda x: F.struct(classify.clean_annotation_title(x).alias("clean"), squeeze(x).alias("plain")))
    labelled = F.size("own") > 0
    title = F.transform(F.filter(strings, lambda s: s["clean"].isNotNull()), lambda s: F.struct((-title_score(F.col("tag"), labelled, s["clean"])).alias("s"), (-F.length(s["clean"])).alias("l"), F.col("node").alias("node"), s["clean"].alias("text")))
    short = F.transform(strings, lambda s: F.struct(F.length(s["plain"]).alias("l"), F.col("node").alias("node"), s["plain"].alias("text")))
    rows = texts.withColumn("title", F.array_min(title)).withColumn("short", F.array_min(short)).drop("own", "parts", "tag")
    rows = normalize.per_distinct(rows, ["text"], text_facts)
    rows = rows.select(
        *CARD, "title", "short",
        F.when(F.col("native").isNotNull(), F.struct("descendants", F.col("native.order").alias("o"), "node", F.col("native.idx").alias("idx"), F.col("native.cents").alias("cents"), F.col("native.unit").alias("unit"), F.col("native.dimension").alias("dimension"))).alias("native"),
        F.transform("money", lambda m: F.struct(m["cents"].alias("cents"), m["against"].alias("against"), F.col("descendants").alias("descendants"), F.col("node").alias("node"))).alias("money"),
        F.transform("labels", lambda x: F.struct(F.col("descendants").alias("descendants"), F.col("node").alias("node"), x["idx"].alias("idx"), x["unit"].alias("unit"), x["dimension"].alias("dimension"), x["source"].alias("source"))).alias("labels"),
    )
    card = rows.groupBy(*CARD).agg(
        F.min("title").alias("title"), F.min("short").alias("short"), F.min("native").alias("native"), F.flatten(F.collect_list("money")).alias("money"), F.flatten(F.collect_list("labels")).alias("labels")
    )
    card = sorted_join(card.where("short is not null"), wanted, CARD)
    # Of equal amounts the one that most speaks for, in the fewest nodes, stays; then they are in order of preference.
    amounts = F.transform(F.array_distinct(F.transform("money", lambda m: m["cents"])), lambda c: F.array_min(F.filter("money", lambda m: m["cents"] == c)))
    order = lambda m: F.struct(m["against"].alias("against"), m["descendants"].alias("descendants"), m["cents"].alias("cents"), m["node"].alias("node"))
    card = card.withColumn("amounts", F.array_sort(F.transform(amounts, order)))
    card = card.withColumn("likely", F.filter("amounts", lambda m: m["against"] <= 0))
    card = card.withColumn("lone", F.when(F.size("likely") == 1, F.col("likely")[0]))
    lone = F.col("lone")
    card = card.withColumn("label", F.array_min(F.filter("labels", lambda x: (x["dimension"] == F.col("target")) & (x["node"] != lone["node"]))))
    label = F.col("label")
    split = F.when(F.col("target").isin("area", "length") & label.isNotNull() & lone.isNotNull(), F.struct(lone["cents"].cast("double").alias("cents"), label["unit"].alias("unit"), label["dimension"].alias("dimension"), F.array(lone["node"], label["node"]).alias("evidence")))
    printed = F.when(F.col("native").isNotNull(), F.struct(F.col("native.cents").alias("cents"), F.col("native.unit").alias("unit"), F.col("native.dimension").alias("dimension"), F.array(F.col("native.node")).alias("evidence")))
    card = card.withColumn("rate", F.coalesce(printed, split))
    text, node = F.coalesce("title.text", "short.text"), F.coalesce("title.node", "short.node")
    card = card.withColumn("name", text).withColumn("name_node", node)
    card = with_title_quantity(card, "name", F.coalesce("rate.dimension", "target"), F.col("rate.unit"), "size")
    base = units.quantity_to_base(F.col("size.value"), F.col("size.unit")) * F.col("size.packs")
    card = card.withColumn("expected", F.when(F.col("rate.dimension") == F.col("size.dimension"), F.col("rate.cents") * base / units.to_base(F.col("rate.unit"))))
    card = card.withColumn("near", F.array_min(F.transform("likely", lambda m: F.struct((F.abs(m["cents"] - F.col("expected")) / F.col("expected")).alias("d"), m["against"].alias("against"), m["cents"].alias("cents"), m["node"].alias("node")))))
    near = F.col("near")
    confirmed = F.when(near["d"] <= DIVERGENCE, F.struct(near["cents"].alias("cents"), near["node"].alias("node")))
    first, second = F.get("likely", F.lit(0)), F.get("likely", F.lit(1))
    leads = F.when((F.size("likely") == 1) | (second["against"] - first["against"] >= LEAD), F.struct(first["cents"].alias("cents"), first["node"].alias("node")))
    card = card.withColumn("price", F.when(F.col("rate").isNull(), leads).otherwise(F.when(F.col("expected").isNotNull(), confirmed)))
    titled = F.col("title").isNotNull()
    method = F.when(titled & F.col("rate").isNotNull(), "native-unit-price").when(titled & F.col("price").isNotNull() & F.col("size").isNotNull(), "price-and-package").otherwise("explicit-abstention")
    card = card.withColumn("method", method)
    abstains = F.col("method") == "explicit-abstention"
    reason = F.when(abstains & ~titled, "not-a-product").when(abstains, validate.abstention_reason(F.when(F.col("size").isNull(), 0).otherwise(1), F.exists("amounts", lambda m: m["against"] > 0)))
    kept = lambda c: F.when(~abstains, F.col(c)).alias({"rate": "native", "size": "quantity"}.get(c, c))
    out = card.select(*CARD, "method", F.col("name").alias("title"), F.col("name_node").alias("title_node"), kept("price"), kept("rate"), kept("size"), reason.alias("abstain_reason"))
    return grounded(out, texts.select(*CARD, "node", "text"))


def grounded(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Annotations with ``issues``: values that the texts of the nodes they cite don't hold."""
    cited = F.array_compact(F.concat(F.array("title_node", "price.node"), F.coalesce("native.evidence", F.array().cast("array<int>"))))
    told = sorted_join(rows.select(*CARD, F.explode(F.array_distinct(cited)).alias("node")), texts, [*CARD, "node"])
    told = told.groupBy(*CARD).agg(F.map_from_entries(F.collect_list(F.struct("node", "text"))).alias("texts"))
    rows = sorted_join(rows, told, CARD, "left")
    at = lambda node: F.col("texts")[node]
    text = F.array_join(F.transform("native.evidence", at), " ")
    apart = F.size("native.evidence") > 1
    rate = F.exists(prices.parse_native_prices(squeeze(F.regexp_replace(F.regexp_replace(text, r"\(\s*/\s*", "/"), r"\s*\)", " "))), lambda m: (m["unit"] == F.col("native.unit")) & grammar.approximately_equal(m["cents"], F.col("native.cents")))
    halves = F.array_contains(F.transform(prices.parse_money(text), lambda m: m["cents"].cast("double")), F.col("native.cents")) & F.exists(prices.parse_per_unit(text), lambda x: x["unit"] == F.col("native.unit"))
    issues = validate.violations(
        ("title-not-in-evidence", ~F.contains(at(F.col("title_node")), F.col("title"))),
        ("price-not-in-evidence", F.col("price").isNotNull() & ~F.array_contains(F.transform(prices.parse_money(at(F.col("price.node"))), lambda m: m["cents"]), F.col("price.cents"))),
        ("rate-not-in-evidence", F.col("native").isNotNull() & ~F.when(apart, halves).otherwise(rate)),
    )
    return rows.withColumn("issues", issues).drop("texts")


def selection_codes(nodes: DataFrame, cards: DataFrame) -> DataFrame:
    """``(page_id, card, titles, values, catalogue)``: how short answers name a card's nodes and candidates.

    ``titles`` maps nodes with text, in document order, to codes; ``values`` maps candidates, by node, kind and number. ``catalogue`` is
    the list of candidates as JSON, for a prompt. A card's nodes and candidates, which its page bounds, are gathered.
    """
    texts = card_texts(nodes, cards).where(joined(F.col("parts")) != "")
    coded = lambda c: F.map_from_entries(F.transform(c, lambda x, i: F.struct(x["id"].alias("id"), base36(i).alias("code"))))
    titles = texts.groupBy(*CARD).agg(F.array_sort(F.collect_list(F.struct("node", F.concat(F.lit("n"), "node").alias("id")))).alias("t"))
    rank = F.instr(F.lit("puqk"), F.col("kind"))
    number = F.regexp_extract("id", "([0-9]+)$", 1).cast("int")
    one = F.struct("node", rank.alias("rank"), number.alias("i"), "id", "kind", "source")
    values = candidates(nodes, cards).groupBy(*CARD).agg(F.array_sort(F.collect_list(one)).alias("v"))
    listed = F.to_json(F.transform("v", lambda x: F.struct(x["id"].alias("id"), x["kind"].alias("kind"), x["source"].alias("sourceText"))))
    return sorted_join(titles, values, CARD, "left").select(*CARD, coded("t").alias("titles"), F.coalesce(coded("v"), F.create_map().cast("map<string,string>")).alias("values"), F.coalesce(listed, F.lit("[]")).alias("catalogue"))


def pointers_to_selections(answers: DataFrame, nodes: DataFrame, key: str = "answer_id") -> DataFrame:
    """``(key, page_id, card, selection)`` of ``answers(key, page_id, answer)`` that resolve; the selection names the first title node.

    A card with more than 1,296 nodes or candidates has none.
    """
    good = resolve_pointers(answers, nodes, key).where("state <> 'invalid'").select(key, "card")
    rows = sorted_join(answers.select(key, PAGE, "answer"), good, key)
    codes = selection_codes(nodes, rows.select(*CARD).distinct()).drop("catalogue")
    rows = sorted_join(rows, codes, CARD)
    value = lambda f: F.col("values")[grammar.line_value(F.col("answer"), f)]
    title = F.col("titles")[F.split(grammar.line_value(F.col("answer"), "TITLE"), ",")[0]]
    lost = title.isNull()
    for f in grammar.KINDS:
        lost = lost | ((grammar.line_value(F.col("answer"), f) != "NONE") & value(f).isNull())
    text = grammar.serialize_selection(title, *map(value, grammar.KINDS), grammar.line_value(F.col("answer"), "STATUS"))
    return rows.select(key, *CARD, F.when(~lost, text).alias("selection"))


def selections_to_pointers(selections: DataFrame, nodes: DataFrame, key: str = "answer_id") -> DataFrame:
    """``(key, page_id, card, answer)`` of ``selections(key, page_id, card, selection)``; null for a wrong form or a code that its card doesn't have."""
    codes = selection_codes(nodes, selections.select(*CARD).distinct()).drop("catalogue")
    turned = lambda c: F.map_from_entries(F.transform(F.map_entries(c), lambda e: F.struct(e["value"].alias("k"), e["key"].alias("v"))))
    rows = sorted_join(selections, codes, CARD).withColumn("titles", turned("titles")).withColumn("values", turned("values"))
    part = lambda i: F.regexp_extract("selection", grammar.SELECTION, i)
    status = F.lit(None).cast("string")
    for name, letter in grammar.STATUS_CODES.items():
        status = F.when(part(6) == letter, name).otherwise(status)
    values = {f: F.when(part(i) != "--", F.col("values")[part(i)]) for i, f in enumerate(grammar.KINDS, 2)}
    lost = F.col("titles")[part(1)].isNull()
    for i, f in enumerate(grammar.KINDS, 2):
        lost = lost | ((part(i) != "--") & values[f].isNull())
    text = grammar.serialize_pointer(F.concat(F.lit("n"), "card"), F.array(F.col("titles")[part(1)]), values, status)
    return rows.select(key, *CARD, F.when(grammar.selection_issue(F.col("selection")).isNull() & ~lost, text).alias("answer"))

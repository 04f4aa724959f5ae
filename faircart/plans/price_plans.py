"""Queries over parsed and normalised prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, prices, text, units
from ..operators import compare, normalize
from .common import RATE, SQL_MACROS, cents_of, dealt, dollars, part_cards, r4, rate_cards, table

sql_r4, sql_cents, sql_dollars = SQL_MACROS["r4"], SQL_MACROS["cents"], SQL_MACROS["dollars"]
QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


UNIT_ROWS = ", ".join(f"('{u}', '{d}', '{label}', {f!r}::DOUBLE)" for u, d, label, f, _ in units.UNITS)
UNIT_CTE = f"u(unit, dimension, label, to_base) AS (VALUES {UNIT_ROWS})"


@query(
    "unit_convert_matrix",
    f"""WITH {UNIT_CTE} SELECT a.unit AS source, b.unit AS target, {sql_r4("100.0 / a.to_base * b.to_base")} AS cents
    FROM u a JOIN u b ON a.dimension = b.dimension AND (a.dimension <> 'count' OR a.unit = b.unit)""",
)
def unit_convert_matrix(spark, sf_dir):
    """A price of 100 cents per unit in every comparable unit (25 rows on either side)."""
    u = units.units_table(spark)
    a, b = u.select(F.col("unit").alias("source"), "dimension"), u.select(F.col("unit").alias("target"), "dimension")
    pairs = a.join(b, "dimension").where(units.units_are_comparable(F.col("source"), F.col("target")))
    return pairs.select("source", "target", r4(units.convert_price(F.lit(100.0), F.col("source"), F.col("target"))).alias("cents"))


@query(
    "unit_aliases",
    f"""WITH a(alias, unit) AS (VALUES {", ".join(f"('{x}', '{u}')" for u, _, _, _, al in units.UNITS for x in al)}), {UNIT_CTE}
    SELECT alias, unit, dimension, label, {sql_r4("5 * to_base")} AS base FROM a JOIN u USING (unit)""",
)
def unit_aliases(spark, sf_dir):
    """Every spelling to its unit, dimension and base quantity."""
    rows = units.units_table(spark).select(F.explode("aliases").alias("alias"))
    unit = units.parse_unit(F.upper("alias"))
    rows = rows.withColumn("unit", unit)
    base = units.quantity_to_base(F.lit(5.0), F.col("unit"))
    return rows.select("alias", "unit", units.dimension_of(F.col("unit")).alias("dimension"), units.label_of(F.col("unit")).alias("label"), r4(base).alias("base"))


@query(
    "money_parse",
    f"""SELECT o_orderkey, c.cents, {sql_dollars("c.cents")} AS source FROM (
      SELECT o_orderkey, unnest([{sql_cents("o_totalprice")}, {sql_cents("o_totalprice / 1000")}]) AS cents FROM orders) c WHERE c.cents BETWEEN 1 AND 500000""",
)
def money_parse(spark, sf_dir):
    """B2: two dollar amounts in a text; those above the limit are dropped."""
    o = table(spark, sf_dir, "orders")
    a, b = cents_of(F.col("o_totalprice")), cents_of(F.col("o_totalprice") / 1000)
    t = F.concat(F.lit("Was "), dollars(a), F.lit(" now "), dollars(b))
    found = o.select("o_orderkey", F.explode(prices.parse_money(t)).alias("m"))
    return found.select("o_orderkey", "m.cents", "m.source")


@query(
    "best_price_pick",
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN b ELSE a END AS cents FROM (
      SELECT o_orderkey, {sql_cents("o_totalprice / 1000")} AS a, {sql_cents("o_totalprice / 500")} AS b FROM orders)
    WHERE a > 0 AND b > 0""",
)
def best_price_pick(spark, sf_dir):
    """The current price among two, by what stands around each."""
    o = table(spark, sf_dir, "orders")
    a, b = dollars(cents_of(F.col("o_totalprice") / 1000)), dollars(cents_of(F.col("o_totalprice") / 500))
    gap = F.lit(" ................................ ")
    plain = F.concat(F.lit("current price "), a, gap, F.lit("list "), b, F.lit(" was"))
    each = F.concat(F.lit("2/"), a, gap, F.lit("or 1/"), b)
    t = F.when(F.col("o_orderkey") % 3 == 0, each).otherwise(plain)
    return o.select("o_orderkey", prices.best_price(t)["cents"].alias("cents"))


@query(
    "native_price_parse",
    f"""SELECT l_orderkey, l_linenumber, CAST({RATE} AS DOUBLE) AS cents, 'lb' AS unit, 'mass' AS dimension FROM lineitem WHERE {RATE} > 0""",
)
def native_price_parse(spark, sf_dir):
    """A printed price per pound."""
    rows = rate_cards(spark, sf_dir).select("l_orderkey", "l_linenumber", "rate_text")
    rows = normalize.per_distinct(rows, ["rate_text"], lambda d: d.withColumn("found", prices.parse_native_prices(F.col("rate_text"))))
    found = rows.select("l_orderkey", "l_linenumber", F.explode("found").alias("p"))
    return found.select("l_orderkey", "l_linenumber", "p.cents", "p.unit", "p.dimension")


@query(
    "quantity_parse",
    """SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN l_quantity * (l_linenumber + 1) WHEN 1 THEN l_quantity * (l_linenumber + 1)
      WHEN 2 THEN l_quantity ELSE l_quantity END AS value, CASE l_linenumber % 4 WHEN 0 THEN 'fl_oz' WHEN 1 THEN 'each' WHEN 2 THEN 'lb' ELSE 'each' END AS unit,
      CASE WHEN l_linenumber % 4 = 0 THEN 3 ELSE 2 END AS quantity_rank FROM lineitem""",
)
def quantity_parse(spark, sf_dir):
    """Multiplied, packed, plain and per-case quantities."""
    line = table(spark, sf_dir, "lineitem")
    n, q, k = F.col("l_linenumber") + 1, F.col("l_quantity").cast("int"), F.col("l_linenumber") % 4
    t = (
        F.when(k == 0, F.concat(n, F.lit(" x "), q, F.lit(" fl oz bottles")))
        .when(k == 1, F.concat(n, F.lit(" pack of "), q, F.lit(" count")))
        .when(k == 2, F.concat(F.lit("Litter, "), q, F.lit(" lbs.")))
        .otherwise(F.concat(q, F.lit("/case")))
    )
    rows = line.select("l_orderkey", "l_linenumber", t.alias("text"))
    rows = normalize.per_distinct(rows, ["text"], lambda d: d.withColumn("q", prices.parse_quantities(F.col("text"))))
    found = rows.select("l_orderkey", "l_linenumber", F.explode("q").alias("q"))
    return found.select("l_orderkey", "l_linenumber", "q.value", "q.unit", F.col("q.rank").alias("quantity_rank"))


@query(
    "pack_count_parse",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 1 THEN CAST(l_quantity AS INTEGER) END AS pack_count FROM lineitem",
)
def pack_count_parse(spark, sf_dir):
    """Eleven ways to say how many are in a pack."""
    line = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("int")
    forms = ("%s pack", "pack of %s", "case of %s", "%s per case", "%s rolls / case", "%s/bx", "%s per pallet", "box of %s", "%s cartons", "%s/case", "total qty %s")
    t = F.lit(None)
    for i, form in enumerate(forms):
        before, after = form.split("%s")
        t = F.when(F.col("l_orderkey") % len(forms) == i, F.concat(F.lit(before), q, F.lit(after))).otherwise(t)
    rows = line.select("l_orderkey", "l_linenumber", t.alias("text"))
    rows = normalize.per_distinct(rows, ["text"], lambda d: d.withColumn("pack_count", prices.pack_count(F.col("text"))))
    return rows.select("l_orderkey", "l_linenumber", "pack_count")


@query(
    "factored_pack_parse",
    """SELECT l_orderkey, l_linenumber, l_quantity AS value, CAST(l_linenumber + 1 AS INTEGER) AS pack_count,
      CASE l_linenumber % 3 WHEN 0 THEN 'oz' ELSE 'each' END AS unit FROM lineitem""",
)
def factored_pack_parse(spark, sf_dir):
    """Value and pack count apart, in three orders."""
    line = table(spark, sf_dir, "lineitem")
    n, q, k = F.col("l_linenumber") + 1, F.col("l_quantity").cast("int"), F.col("l_linenumber") % 3
    t = (
        F.when(k == 0, F.concat(n, F.lit(" x "), q, F.lit(" oz")))
        .when(k == 1, F.concat(q, F.lit(" each x "), n, F.lit(" pack")))
        .otherwise(F.concat(n, F.lit(" pack of "), q, F.lit(" count")))
    )
    found = line.select("l_orderkey", "l_linenumber", F.explode(prices.parse_factored(t)).alias("q"))
    return found.select("l_orderkey", "l_linenumber", "q.value", "q.pack_count", "q.unit")


#: Unit price of a part card in DuckDB: cents per pound from price and ounces.
PART_CENTS = f"({sql_cents('p_retailprice')} / (p_size * 1.0)) * 16"
FIXED = "CASE WHEN {c} >= 100 THEN NULL ELSE 0 END"


@query(
    "part_unit_price",
    f"""SELECT p_partkey, {sql_r4(PART_CENTS)} AS cents, 'lb' AS unit, 'mass:lb' AS compare_key, {sql_cents("p_retailprice")} AS price_cents FROM part
    WHERE {sql_cents("p_retailprice")} BETWEEN 1 AND 500000""",
)
def part_unit_price(spark, sf_dir):
    """D8 end to end: title and price text to a normalised price per pound."""
    rows = normalize.extract(part_cards(spark, sf_dir))
    return rows.select("p_partkey", r4(F.col("normalized.cents")).alias("cents"), "normalized.unit", "normalized.compare_key", "price_cents")


@query(
    "lowest_of_n",
    f"""WITH p AS (SELECT p_partkey, p_brand, {PART_CENTS} AS cents FROM part WHERE {sql_cents("p_retailprice")} BETWEEN 1 AND 500000),
    w AS (SELECT *, count(*) OVER (PARTITION BY p_brand) AS n, min(cents) OVER (PARTITION BY p_brand) AS least FROM p)
    SELECT p_partkey, p_brand, {sql_r4("cents")} AS cents, n AS lowest_of FROM w WHERE n >= 3 AND cents - least <= 0.0001""",
)
def lowest_of_n(spark, sf_dir):
    """The cheapest comparable items of every brand (the flagship query)."""
    rows = normalize.extract(part_cards(spark, sf_dir))
    # Read three times: for titles, for the sizes of cohorts and for their members.
    rows = normalize.checkpointed(rows.select("p_partkey", "p_brand", "title", "normalized.cents", "normalized.compare_key", "normalized.dimension"))
    rows = normalize.per_distinct(rows, ["title", "dimension"], lambda d: d.withColumn("family", classify.family(F.col("title"), F.col("dimension"))))
    low = compare.lowest_of_n(rows, ["p_brand", "compare_key", "family"])
    return low.select("p_partkey", "p_brand", r4(F.col("cents")).alias("cents"), "lowest_of")


@query(
    "comparison_groups",
    """WITH k AS (SELECT CASE l_linenumber % 3 WHEN 0 THEN 'lb' WHEN 1 THEN 'fl_oz' ELSE 'each' END AS unit,
      CASE l_linenumber % 3 WHEN 0 THEN 'mass' WHEN 1 THEN 'volume' ELSE 'count' END AS dimension,
      CASE l_linenumber % 3 WHEN 0 THEN 'lb' WHEN 1 THEN 'fl oz' ELSE 'count' END AS label FROM lineitem)
    SELECT concat(dimension, ':', unit) AS compare_key, unit, dimension, count(*) AS count, concat('per ', label) AS label,
      concat('Unit price per ', label, ': low to high') AS sort_label FROM k GROUP BY ALL""",
)
def comparison_groups(spark, sf_dir):
    """G1: groups by compare key with their labels."""
    k = F.col("l_linenumber") % 3
    unit = F.when(k == 0, "lb").when(k == 1, "fl_oz").otherwise("each")
    rows = table(spark, sf_dir, "lineitem").select(unit.alias("unit"))
    rows = rows.select("unit", units.dimension_of(F.col("unit")).alias("dimension"), units.compare_key(F.col("unit")).alias("compare_key"))
    return compare.comparison_groups(rows)


@query(
    "slot_sort",
    f"""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, {RATE} AS cents,
      row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_returnflag, l_extendedprice, l_quantity) AS pos FROM lineitem),
    s AS (SELECT l_suppkey, unnest(list(pos ORDER BY cents, pos)) AS pos, unnest(list(pos ORDER BY pos)) AS new_pos FROM r GROUP BY l_suppkey, l_returnflag)
    SELECT l_suppkey, pos, new_pos, pos <> new_pos AS moved FROM s""",
)
def slot_sort(spark, sf_dir):
    """H4: members of a family swap places among their own slots by price."""
    line = table(spark, sf_dir, "lineitem")
    rate = cents_of(F.col("l_extendedprice") / F.col("l_quantity") / 1000)
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_extendedprice", "l_quantity"]
    rows = compare.numbered(line.select("l_suppkey", *order, rate.alias("cents")), ["l_suppkey"], order, "pos", F.floor(F.col("l_orderkey") / 10_000)).drop(*(c for c in order if c != "l_returnflag"))
    return compare.slot_sort(rows, ["l_suppkey"], "l_returnflag").select("l_suppkey", "pos", "new_pos", "moved")


@query(
    "default_compare_key",
    """WITH f AS (SELECT l_suppkey, l_returnflag AS k, l_linestatus AS f, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT k AS compare_key, CAST(sum(n) AS BIGINT) AS sortable FROM f WHERE n >= 2 GROUP BY k ORDER BY sortable DESC, k LIMIT 1""",
)
def default_compare_key(spark, sf_dir):
    """The key with most sortable rows."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_returnflag").alias("compare_key"), F.col("l_linestatus").alias("family"))
    return compare.default_compare_key(rows, ["l_suppkey"])


@query(
    "native_vs_package",
    f"""WITH j AS (SELECT l_orderkey, l_linenumber, CAST(p_size AS DOUBLE) AS size, p_size * ({RATE}) AS price, l_partkey % 5 AS k, {RATE} AS rate FROM lineitem
      JOIN part ON l_partkey = p_partkey WHERE {RATE} > 0 AND p_size * ({RATE}) BETWEEN 1 AND 500000),
    c AS (SELECT *, CAST(floor(rate * (100 + 3 * k) / 100) AS BIGINT) AS shown FROM j)
    SELECT l_orderkey, l_linenumber, CASE WHEN shown = 0 THEN 'package' WHEN abs(shown - price / (size * 16) * 16) / shown <= 0.08 THEN 'native' ELSE 'abstain' END AS choice FROM c""",
)
def native_vs_package(spark, sf_dir):
    """Printed and computed rates that agree, or an abstention."""
    line, part = rate_cards(spark, sf_dir), table(spark, sf_dir, "part").select("p_partkey", "p_size")
    j = line.join(part, F.col("l_partkey") == F.col("p_partkey")).where("rate_cents > 0")
    j = j.withColumn("price_cents", F.col("p_size") * F.col("rate_cents")).where("price_cents between 1 and 500000")
    shown = F.floor(F.col("rate_cents") * (100 + 3 * (F.col("l_partkey") % 5)) / 100)
    title = F.concat(F.lit("Cat Litter, "), "p_size", F.lit(" lb"))
    rows = j.select("l_orderkey", "l_linenumber", title.alias("title"), "price_cents", F.concat(dollars(shown), F.lit("/lb")).alias("text"))

    def facts(titles):
        quantity = F.try_element_at(prices.parse_quantities(F.col("title")), F.lit(1))
        return titles.withColumn("package", quantity).withColumn("pack_count", prices.pack_count(F.col("title")))

    def rate(texts):
        return texts.withColumn("native", F.try_element_at(prices.parse_native_prices(F.col("text")), F.lit(1)))

    rows = normalize.per_distinct(normalize.per_distinct(rows, ["title"], facts), ["text"], rate)
    return normalize.normalize(rows).select("l_orderkey", "l_linenumber", "choice")


TITLES = (
    ("Gaming Laptop, %s lb", "equipment-capacity-as-quantity"),
    ("Cat Litter, %s lb", None),
    ("Mosaic Tile, %s lb", "material-weight-as-quantity"),
    ("Denim Fabric, %s lb", "material-weight-as-quantity"),
    ("Storage Bags, %s gal", "container-capacity-as-quantity"),
    ("Automatic Soap Dispenser, %s ml", "container-size-as-quantity"),
    ("Paper Plates, %s inch", "physical-dimension-as-quantity"),
    ("Nylon Rope, %s ft", None),
    ("Water Filter %s gal/min", "equipment-capacity-as-quantity"),
    ("Vinegar, %s gal", None),
)


@query(
    "quantity_rejection",
    "SELECT p_partkey, CASE p_partkey % 10 " + " ".join(f"WHEN {i} THEN {'NULL' if r is None else repr(r)}" for i, (_, r) in enumerate(TITLES)) + " END AS reason FROM part",
)
def quantity_rejection(spark, sf_dir):
    """Why a quantity in a title is no package size."""
    part = table(spark, sf_dir, "part")
    title = F.lit(None)
    for i, (form, _) in enumerate(TITLES):
        before, after = form.split("%s")
        title = F.when(F.col("p_partkey") % len(TITLES) == i, F.concat(F.lit(before), "p_size", F.lit(after))).otherwise(title)
    rows = part.select("p_partkey", title.alias("title"))
    q = F.try_element_at(prices.parse_quantities(F.regexp_replace("title", "/min", " per min")), F.lit(1))
    return rows.withColumn("q", q).select("p_partkey", classify.reject(F.col("title"), F.col("q")).alias("reason"))


FAMILIES = (
    ("Liquid Laundry Detergent 92 fl oz", "laundry:detergent-liquid"),
    ("Laundry Detergent Pods 42 ct", "laundry:detergent-pod"),
    ("Powder Laundry Detergent 5 lb", "laundry:detergent-powder"),
    ("Fabric Softener 34 fl oz", "laundry:fabric-softener"),
    ("Laundry Stain Remover 22 fl oz", "laundry:stain-remover"),
    ("Pod Storage Containers for laundry", "general"),
    ("Scent Booster Beads 20 oz", "laundry:scent-booster"),
    ("Dish Detergent Liquid 20 fl oz", "general"),
    ("Laundry Bleach 64 fl oz", "laundry:bleach"),
    ("Washing Machine Cleaner Tablets", "laundry:washer-cleaner"),
)


@query("comparison_family", "SELECT p_partkey, CASE p_partkey % 10 " + " ".join(f"WHEN {i} THEN '{f}'" for i, (_, f) in enumerate(FAMILIES)) + " END AS family FROM part")
def comparison_family(spark, sf_dir):
    """What an item substitutes for."""
    part = table(spark, sf_dir, "part")
    title = F.element_at(F.array(*(F.lit(t) for t, _ in FAMILIES)), (F.col("p_partkey") % len(FAMILIES) + 1).cast("int"))
    return part.select("p_partkey", title.alias("title")).select("p_partkey", classify.family(F.col("title"), F.lit("mass")).alias("family"))


def _sql_fixed(x: str, digits: int) -> str:
    """Fixed decimals of the exact value, exact ties up, for DuckDB."""
    scale, step = 2 ** (digits + 1), 10**digits
    tie = f"(({x}) * {scale} = floor(({x}) * {scale}) AND CAST(floor(({x}) * {scale}) AS BIGINT) % 2 = 1)"
    return f"printf('%.{digits}f', CASE WHEN {tie} THEN (floor(({x}) * {step}) + 1) / {step} ELSE ({x}) END)"


def _sql_trim(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '\.0+$', ''), '(\.\d*?)0+$', '\1')"


SMALL = _sql_trim(f"CASE WHEN c >= 10 THEN {_sql_fixed('c', 1)} ELSE {_sql_fixed('c', 2)} END")


@query(
    "format_display",
    f"""WITH r AS (SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity / 512 AS c FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN c < 100 THEN concat({SMALL}, '¢/oz') ELSE concat('$', {_sql_fixed("c / 100", 2)}, '/oz') END AS display FROM r""",
)
def format_display(spark, sf_dir):
    """A rate as it is shown."""
    c = F.col("l_extendedprice") / F.col("l_quantity") / 512
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", prices.format_price(c, F.lit("oz")).alias("display"))


@query(
    "accessible_price",
    f"""WITH r AS (SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity / 512 AS c FROM lineitem),
    w AS (SELECT *, CAST(floor(c + 0.5) AS BIGINT) // 100 AS d, CAST(floor(c + 0.5) AS BIGINT) % 100 AS e FROM r)
    SELECT l_orderkey, l_linenumber, concat(CASE WHEN c < 100 THEN concat({SMALL}, CASE WHEN abs(c - 1) < 0.0001 THEN ' cent' ELSE ' cents' END)
      ELSE concat(d, CASE WHEN d = 1 THEN ' dollar' ELSE ' dollars' END, CASE WHEN e = 0 THEN '' ELSE concat(' and ', e, CASE WHEN e = 1 THEN ' cent' ELSE ' cents' END) END) END,
      ' per ounce') AS spoken FROM w""",
)
def accessible_price(spark, sf_dir):
    """A rate as it is read out."""
    c = F.col("l_extendedprice") / F.col("l_quantity") / 512
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", prices.accessible_price(c, F.lit("oz")).alias("spoken"))


@query(
    "title_dedupe",
    """SELECT p_partkey, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, lower(p_name), p_type ORDER BY p_partkey) AS r FROM part) WHERE r = 1""",
)
def title_dedupe(spark, sf_dir):
    """The first of equal titles and displays in a scope."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_name").alias("title"), F.col("p_type").alias("display"))
    return compare.dedupe_products(rows, ["p_brand"], "p_partkey").select("p_partkey", "p_brand")


@query(
    "price_audit",
    f"""WITH p AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'add' WHEN 1 THEN 'target' WHEN 2 THEN 'cheap' END AS k FROM part WHERE {sql_cents("p_retailprice")} BETWEEN 1 AND 500000)
    SELECT p_partkey, CASE k WHEN 'add' THEN 'non-product-title' WHEN 'target' THEN 'target-dimension-mismatch' ELSE 'implausibly-low-count-price' END AS reason,
      CASE k WHEN 'add' THEN 'error' WHEN 'target' THEN 'info' ELSE 'review' END AS severity FROM p WHERE k IS NOT NULL""",
)
def price_audit(spark, sf_dir):
    """Findings on normalised products."""
    k = F.col("p_partkey") % 4
    cents = cents_of(F.col("p_retailprice"))
    title = F.when(k == 0, F.lit("Add to cart, 4 lb")).when(k == 2, F.lit("Toothpicks, 90000 count")).otherwise(F.lit("Cat Litter, 4 lb"))
    part = table(spark, sf_dir, "part").where(cents.between(1, 500_000)).select("p_partkey", title.alias("title"), k.alias("k"))
    rows = dealt(part, "p_partkey").withColumn("price_cents", F.when(F.col("k") == 2, 100).otherwise(500).cast("long")).withColumn("pack_count", F.lit(None).cast("int"))
    rows = rows.withColumn("native", F.try_element_at(prices.parse_native_prices(F.lit("")), F.lit(1)))
    rows = normalize.per_distinct(rows, ["title"], lambda d: d.withColumn("package", F.try_element_at(prices.parse_quantities(F.col("title")), F.lit(1))))
    rows = normalize.normalize(rows)
    target = F.when(F.col("k") == 1, "volume")
    return normalize.audit(rows, target).select("p_partkey", "finding.reason", "finding.severity")


@query(
    "card_scores",
    # Amount 4, rate 4, product word 3, link 2, then an action word 1 or a picture 1.
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 1 THEN 4 + 4 + 3 + 2 + 1 WHEN 2 THEN 4 + 4 + 3 + 2 + 1 ELSE 0 END AS score FROM orders""",
)
def card_scores(spark, sf_dir):
    """How much an element looks like a product card."""
    k = F.col("o_orderkey") % 4
    t = F.when(k == 0, "short").when(k == 1, "Great cat litter $14.83 67.4 ¢/lb add to cart").when(k == 2, "Great cat litter 22 lb $14.83 $1.00/lb here")
    t = t.otherwise("The average cost of a litter is $14.83 67.4 ¢/lb")
    return table(spark, sf_dir, "orders").select("o_orderkey", classify.card_score(t, k > 0, k == 2, F.lit(False)).alias("score"))


CLEAN = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query(
    "candidate_titles",
    rf"""SELECT conv_id, turn, {CLEAN} AS title FROM conversations WHERE length({CLEAN}) BETWEEN 8 AND 220
      AND NOT regexp_matches({CLEAN},
      '(?i)^(?:add|remove|compare|subscribe|sponsored|shipping|pickup|delivery|options|quick view|buy|sign in|create account)\b|^\$|^\d+\s+pack$|^\d(?:\.\d)?\s+out of 5 stars?\b|^\d+(?:\.\d+)?%\s+off\b')""",
)
def candidate_titles(spark, sf_dir):
    """C11: texts that could be a title, by their whole length."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", classify.clean_candidate_title(F.col("text")).alias("title"))
    return rows.where("title is not null")


@query(
    "product_evidence",
    "SELECT event_id, event_type IN ('click', 'error') AS evidence FROM events",
)
def product_evidence(spark, sf_dir):
    """C17: changes on a page that are worth a new scan."""
    kind = F.col("event_type")
    t = F.when(kind == "click", "now $ 5").when(kind == "error", "a 12 fl oz can").otherwise("nothing new")
    return table(spark, sf_dir, "events").select("event_id", classify.is_product_evidence(t).alias("evidence"))


@query(
    "title_hash",
    r"""SELECT doc_id, sha256(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS hash FROM documents WHERE text IS NOT NULL""",
)
def title_hash(spark, sf_dir):
    """Whole texts that differ in case and marks only share a hash."""
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.title_hash(F.col("text")).alias("hash"))

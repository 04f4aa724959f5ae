"""Queries over gates, grounding, audits, picks and model answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, prices, units
from ..operators import compare, normalize, validate
from ..sources import html, model
from .common import SQL_MACROS, cents_of, dollars, registry, table

QUERIES, ORACLE_SQL, query = registry()
sql_cents, sql_dollars = SQL_MACROS["cents"], SQL_MACROS["dollars"]


@query(
    "capture_gates",
    """WITH c AS (SELECT page_id, page_id % 11 = 0 AS blocked, len(regexp_extract_all(html, '<li>')) AS candidates, page_id % 13 = 0 AS truncated, (page_id % 10) / 30.0 AS obstruction,
      CASE WHEN page_id % 7 = 0 THEN 0.5 ELSE 1 END AS coverage, page_id % 17 <> 0 AS screenshot, md5(html) AS hash FROM pages),
    r AS (SELECT page_id, CASE WHEN page_id % 19 = 0 THEN 'x' ELSE md5(html) END AS known FROM pages WHERE page_id % 5 <> 0)
    SELECT c.page_id, array_to_string(list_filter([CASE WHEN blocked THEN 'blocked' END, CASE WHEN candidates < 5 THEN 'too-few-candidates' END, CASE WHEN truncated THEN 'truncated' END,
      CASE WHEN obstruction > 0.2 THEN 'obstructed' END, CASE WHEN coverage < 1 THEN 'query-not-covered' END, CASE WHEN NOT screenshot THEN 'no-screenshot' END,
      CASE WHEN known IS NULL THEN 'not-registered' END, CASE WHEN known <> hash THEN 'hash-mismatch' END], lambda x: x IS NOT NULL), ',') AS issues FROM c LEFT JOIN r ON c.page_id = r.page_id""",
)
def capture_gates(spark, sf_dir):
    """Why captures may not be used."""
    i = F.col("page_id")
    p = table(spark, sf_dir, "pages").select(
        "page_id", (i % 11 == 0).alias("blocked"), F.regexp_count("html", F.lit("<li>")).alias("candidates"), (i % 13 == 0).alias("truncated"), ((i % 10) / 30.0).alias("obstruction"),
        F.when(i % 7 == 0, 0.5).otherwise(1.0).alias("coverage"), (i % 17 != 0).alias("screenshot"), F.md5("html").alias("hash"),
    )
    r = p.where("page_id % 5 <> 0").select("page_id", F.when(i % 19 == 0, "x").otherwise(F.col("hash")).alias("hash"))
    return validate.capture_gates(p, r, least=5).select("page_id", F.array_join("issues", ",").alias("issues"))


@query(
    "evidence_validate",
    f"""WITH p AS (SELECT p_partkey, p_partkey // 4 AS page_id, p_partkey % 3 AS card, {sql_cents("p_retailprice")} AS cents, p_partkey % 6 AS k FROM part),
    n AS (SELECT *, count(*) OVER (PARTITION BY page_id, card) AS times FROM p)
    SELECT p_partkey, array_to_string(list_filter([CASE WHEN times > 1 THEN 'duplicate-card' END, CASE WHEN k = 1 THEN 'title-not-in-evidence' END, CASE WHEN k = 2 THEN 'price-not-in-evidence' END,
      CASE WHEN k = 3 THEN 'quantity-not-in-evidence' END], lambda x: x IS NOT NULL), ',') AS issues,
      CASE WHEN times > 1 OR k BETWEEN 1 AND 3 THEN 'rejected' WHEN k = 4 THEN 'abstained' ELSE 'accepted' END AS status FROM n""",
)
def evidence_validate(spark, sf_dir):
    """Extracted products against the text that they cite."""
    k, cents = F.col("p_partkey") % 6, cents_of(F.col("p_retailprice"))
    text = F.concat("p_name", F.lit(", 7 oz current price "), dollars(cents), F.lit(" was $3.01 $0.99/oz"))
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.floor(F.col("p_partkey") / 4).alias("page_id"), (F.col("p_partkey") % 3).alias("card"), text.alias("card_text"), F.when(k == 1, "another thing").otherwise(F.col("p_name")).alias("title"),
        F.when(k == 4, F.lit(None)).when(k == 2, 99).otherwise(cents).cast("long").alias("cents"), F.when(k == 4, F.lit(None)).when(k == 3, 8.0).otherwise(7.0).alias("value"), F.lit("oz").alias("unit"),
        F.when(k == 4, "price-range").alias("abstain_reason"),
    )
    return validate.validate_extractions(rows).select("p_partkey", F.array_join("issues", ",").alias("issues"), "status")


@query(
    "campaign_audit",
    """WITH q AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 2 = 0), s AS (SELECT doc_id, doc_id % 7 <> 0 AS parsed FROM labels UNION ALL SELECT doc_id, TRUE FROM labels WHERE doc_id % 10 = 4),
    g AS (SELECT doc_id, count(*) AS n, bool_and(parsed) AS ok FROM s GROUP BY doc_id)
    SELECT coalesce(q.doc_id, g.doc_id) AS doc_id, CASE WHEN n IS NULL THEN 'missing' WHEN q.doc_id IS NULL THEN 'unexpected' WHEN NOT ok THEN 'malformed' WHEN n > 1 THEN 'duplicate' ELSE 'accepted' END AS state
    FROM q FULL JOIN g ON q.doc_id = g.doc_id""",
)
def campaign_audit(spark, sf_dir):
    """Submissions of a campaign, accepted or put aside."""
    l = table(spark, sf_dir, "labels").select("doc_id", (F.col("doc_id") % 7 != 0).alias("parsed"))
    s = l.unionByName(l.where("doc_id % 10 = 4").withColumn("parsed", F.lit(True)))
    return validate.audit_campaign(table(spark, sf_dir, "documents").where("doc_id % 2 = 0"), s, "doc_id")


@query(
    "adjudication_issues",
    """WITH a AS (SELECT o_orderkey, o_custkey % 5 AS adjudicator, o_custkey % 3 AS a, o_custkey % 4 AS b, o_orderkey % 9 AS late FROM orders)
    SELECT o_orderkey, array_to_string(list_filter([CASE WHEN adjudicator = a OR adjudicator = b THEN 'same-identity' END, CASE WHEN late = 0 THEN 'not-later' END,
      CASE WHEN a = b THEN 'one-reviewer' END], lambda x: x IS NOT NULL), ',') AS issues FROM a""",
)
def adjudication_issues(spark, sf_dir):
    """An adjudicator is a third person and comes later."""
    c = F.col("o_custkey")
    issues = validate.violations(("same-identity", (c % 5 == c % 3) | (c % 5 == c % 4)), ("not-later", F.col("o_orderkey") % 9 == 0), ("one-reviewer", c % 3 == c % 4))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(issues, ",").alias("issues"))


@query(
    "domain_qualification",
    """SELECT s_suppkey, array_to_string(list_filter([CASE WHEN s_acctbal < 0 THEN 'no-budget' END, CASE WHEN n.n_nationkey IS NULL THEN 'unknown-nation' END, CASE WHEN d > 1 THEN 'duplicate-name' END], lambda x: x IS NOT NULL), ',') AS issues
    FROM (SELECT *, count(*) OVER (PARTITION BY s_nationkey) AS d FROM supplier) s LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) n ON s_nationkey = n_nationkey""",
)
def domain_qualification(spark, sf_dir):
    """Uniqueness, membership and bounds of domains."""
    s = table(spark, sf_dir, "supplier")
    d = s.groupBy("s_nationkey").agg(F.count("*").alias("d"))
    n = table(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("s_nationkey"), F.lit(True).alias("known"))
    rows = s.join(d, "s_nationkey").join(n, "s_nationkey", "left")
    issues = validate.violations(("no-budget", F.col("s_acctbal") < 0), ("unknown-nation", F.col("known").isNull()), ("duplicate-name", F.col("d") > 1))
    return rows.select("s_suppkey", F.array_join(issues, ",").alias("issues"))


@query(
    "policy_gates",
    """SELECT r.o_orderkey, CASE WHEN r.o_orderkey % 10 < 3 AND p.o_orderkey IS NULL THEN 'parent-missing' WHEN r.o_totalprice > 300000 THEN 'over-cap' WHEN p.o_orderstatus = 'F' THEN 'parent-failed' END AS gate
    FROM orders r LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 4 <> 0) p ON r.o_orderkey // 10 * 10 + 1 = p.o_orderkey""",
)
def policy_gates(spark, sf_dir):
    """Runs against the policy, with their parent run."""
    o = table(spark, sf_dir, "orders")
    p = o.where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("parent"), F.col("o_orderstatus").alias("state"))
    rows = o.withColumn("parent", F.floor(F.col("o_orderkey") / 10) * 10 + 1).join(p, "parent", "left")
    gate = F.when((F.col("o_orderkey") % 10 < 3) & F.col("state").isNull(), "parent-missing").when(F.col("o_totalprice") > 300_000, "over-cap").when(F.col("state") == "F", "parent-failed")
    return rows.select("o_orderkey", gate.alias("gate"))


@query(
    "silver_promotion",
    """SELECT source, count(*) AS audits, min(lang) <> 'xx' AND bool_or(quality = 1 AND toxic = 0) AS promoted FROM documents JOIN labels USING (doc_id) GROUP BY source""",
)
def silver_promotion(spark, sf_dir):
    """A reviewed source is promoted if any of its audits is eligible."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("source")
    return rows.agg(F.count("*").alias("audits"), ((F.min("lang") != "xx") & F.bool_or(F.expr("quality = 1 and toxic = 0"))).alias("promoted"))


@query(
    "evidence_modes",
    """SELECT o_orderkey, CASE WHEN n AND p AND q THEN 'both' WHEN n THEN 'native' WHEN p AND q THEN 'package' ELSE 'none' END AS mode,
      CASE WHEN q THEN CASE WHEN o_orderkey % 4 = 1 THEN 'conditional-price' ELSE 'insufficient-evidence' END ELSE 'ambiguous-quantity' END AS reason
    FROM (SELECT o_orderkey, o_orderkey % 2 = 0 AS n, o_custkey % 3 = 0 AS p, o_custkey % 5 < 3 AS q FROM orders)""",
)
def evidence_modes(spark, sf_dir):
    """What labels rest on, and why others abstain."""
    i, c = F.col("o_orderkey"), F.col("o_custkey")
    mode = validate.evidence_mode(i % 2 == 0, c % 3 == 0, c % 5 < 3)
    return table(spark, sf_dir, "orders").select("o_orderkey", mode.alias("mode"), validate.abstention_reason(F.when(c % 5 < 3, 1).otherwise(0), i % 4 == 1).alias("reason"))


@query(
    "dataset_equality",
    """(SELECT 'left' AS side, doc_id, lang FROM (SELECT doc_id, lang FROM documents EXCEPT ALL SELECT doc_id, CASE WHEN doc_id % 20 = 0 THEN 'xx' ELSE lang END FROM documents WHERE doc_id % 30 <> 1))
    UNION ALL (SELECT 'right', doc_id, lang FROM (SELECT doc_id, CASE WHEN doc_id % 20 = 0 THEN 'xx' ELSE lang END AS lang FROM documents WHERE doc_id % 30 <> 1 EXCEPT ALL SELECT doc_id, lang FROM documents))""",
)
def dataset_equality(spark, sf_dir):
    """Two manifests list the same records, or where they differ."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return validate.same_rows(d, d.where("doc_id % 30 <> 1").withColumn("lang", F.when(F.col("doc_id") % 20 == 0, "xx").otherwise(F.col("lang"))))


@query(
    "extraction_audit",
    """SELECT l_orderkey, l_linenumber, abs(l_extendedprice / l_quantity - l_extendedprice / 20) / (l_extendedprice / 20) > 0.2 AS diverges, l_extendedprice >= 1000 AND l_quantity > 1 AS eligible FROM lineitem""",
)
def extraction_audit(spark, sf_dir):
    """Extracted values whose arithmetic does not agree."""
    p, q = F.col("l_extendedprice"), F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", validate.divergence(p / 20, p, q).alias("diverges"), ((p >= 1000) & (q > 1)).alias("eligible"))


@query(
    "title_links",
    """WITH l AS (SELECT p_brand, p_partkey, p_name || ' of ' || p_type AS text, CASE p_partkey % 3 WHEN 0 THEN 'vendor' WHEN 1 THEN 'product-title' ELSE '' END AS classes, CASE p_partkey % 2 WHEN 0 THEN '/products/1' ELSE '/collections/2' END AS path FROM part),
    s AS (SELECT *, CASE p_partkey % 3 WHEN 0 THEN -6 WHEN 1 THEN 8 ELSE 0 END + CASE p_partkey % 2 WHEN 0 THEN 5 ELSE -6 END AS score FROM l WHERE length(text) BETWEEN 8 AND 220),
    r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, length(text) DESC, text) AS r FROM s) SELECT p_brand, text, score FROM r WHERE r = 1""",
)
def title_links(spark, sf_dir):
    """The link of a card that is its title."""
    i = F.col("p_partkey")
    links = table(spark, sf_dir, "part").select(
        "p_brand", F.concat("p_name", F.lit(" of "), "p_type").alias("text"), F.when(i % 3 == 0, "vendor").when(i % 3 == 1, "product-title").otherwise("").alias("classes"),
        F.when(i % 2 == 0, "/products/1").otherwise("/collections/2").alias("path"),
    )
    return validate.title_links(links, ["p_brand"]).select("p_brand", "text", "score")


@query(
    "line_titles",
    """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || ' 12 oz' WHEN 1 THEN 'a roll of ' || p_name END AS title FROM part""",
)
def line_titles(spark, sf_dir):
    """The first line of a card with a product word."""
    i = F.col("p_partkey") % 3
    last = F.when(i == 0, F.concat("p_name", F.lit(" 12 oz"))).when(i == 1, F.concat(F.lit("a roll of "), "p_name")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", validate.line_title(F.concat(F.lit("Sale\n"), last, F.lit("\n$ 3"))).alias("title"))


@query(
    "box_validity",
    """SELECT l_orderkey, l_linenumber, l_extendedprice / 100 + l_quantity <= 1000 AND l_quantity * 20 + l_tax * 100 <= 1000 AND l_tax > 0 AS valid FROM lineitem""",
)
def box_validity(spark, sf_dir):
    """C20: boxes with an area inside the page."""
    valid = validate.box_is_valid(F.col("l_extendedprice") / 100, F.col("l_quantity") * 20, F.col("l_quantity"), F.col("l_tax") * 100)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", valid.alias("valid"))


@query("box_matching")
def box_matching(spark, sf_dir):
    """one-to-one matches, the largest overlap first (order-dependent, so without SQL; tested against brute force)."""
    line = table(spark, sf_dir, "lineitem")
    pairs = line.groupBy("l_suppkey", (F.col("l_partkey") % 40).alias("predicted"), (F.col("l_orderkey") % 40).alias("target")).agg(F.max("l_discount").alias("iou"))
    return validate.match_boxes(pairs, "l_suppkey")


@query(
    "containment_join",
    """WITH p AS (SELECT p_partkey, p_brand, p_name FROM part), l AS (SELECT DISTINCT p_brand, split_part(p_name, ' ', 1) AS label FROM part WHERE p_partkey % 5 = 0),
    j AS (SELECT l.p_brand, l.label, p_partkey, p_name FROM l JOIN p ON l.p_brand = p.p_brand AND l.label = split_part(p_name, ' ', 1)),
    r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, label ORDER BY length(p_name), p_name, p_partkey) AS r FROM j) SELECT p_brand, label, p_partkey FROM r WHERE r = 1""",
)
def containment_join(spark, sf_dir):
    """the shortest text of a page that holds a label."""
    from ..operators.selection import first_n

    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name", F.split("p_name", " ")[0].alias("label"))
    l = p.where("p_partkey % 5 = 0").select("p_brand", "label").distinct()
    return first_n(p.join(l, ["p_brand", "label"]), ["p_brand", "label"], 1, F.length("p_name"), "p_name", "p_partkey").select("p_brand", "label", "p_partkey")


@query(
    "evidence_candidates",
    f"""SELECT p_partkey, concat('n', p_partkey, '@p0') AS id, {sql_dollars(sql_cents("p_retailprice"))} AS source FROM part WHERE {sql_cents("p_retailprice")} BETWEEN 1 AND 500000
    UNION ALL SELECT p_partkey, concat('n', p_partkey, '@q0'), concat(p_size, ' oz') FROM part""",
)
def evidence_candidates(spark, sf_dir):
    """The prices and quantities of each node, numbered by kind."""
    text = F.concat("p_name", F.lit(", "), "p_size", F.lit(" oz now "), dollars(cents_of(F.col("p_retailprice"))))
    rows = table(spark, sf_dir, "part").select("p_partkey", text.alias("text"))
    own = lambda kind, parsed: rows.select("p_partkey", F.posexplode(parsed).alias("i", "c")).select("p_partkey", F.concat(F.lit("n"), "p_partkey", F.lit(f"@{kind}"), "i").alias("id"), "c.source")
    return own("p", prices.parse_money(F.col("text"))).unionByName(own("q", prices.parse_quantities(F.col("text"))))


SPECIAL = (
    ("Liquid Dish Soap, 24 oz", "fl_oz"), ("Laundry Detergent Pods, 42 ct", "pod"), ("Dryer Sheets, 80 count", "sheet"), ("Washing Machine Cleaner Tablets, 6 ct", "tablet"),
    ("Cat Litter, 24 oz", "oz"), ("Paper Towels, 120 count", "sheet"), ("Sunflower Oil, 16 oz", "fl_oz"), ("Olive Oil, 16 oz", "oz"), ("Pod storage container, 12 ct", "each"),
)


@query("specialised_units", "SELECT p_partkey, [" + ", ".join(f"'{u}'" for _, u in SPECIAL) + f"][CAST(p_partkey % {len(SPECIAL)} + 1 AS INTEGER)] AS unit FROM part")
def specialised_units(spark, sf_dir):
    """Units that the title makes more precise."""
    title = F.element_at(F.array(*(F.lit(t) for t, _ in SPECIAL)), (F.col("p_partkey") % len(SPECIAL) + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", title.alias("title"))

    def special(titles):
        q = F.transform(prices.parse_quantities(F.col("title")), lambda x: classify.specialize(F.col("title"), x))
        return titles.withColumn("unit", prices.select_quantity(q)["unit"])

    return normalize.per_distinct(rows, ["title"], special).select("p_partkey", "unit")


@query(
    "pack_multipliers",
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 6 WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 1 WHEN 4 THEN NULL ELSE 1 END AS times FROM part""",
)
def pack_multipliers(spark, sf_dir):
    """How often a quantity stands in a package."""
    cases = (("Sparkling Water, 12 fl oz, pack of 6", 12.0, "fl_oz", "volume", "12 fl oz", 6), ("Detergent Pods, 42 count total, 2 pack", 42.0, "pod", "count", "42 count", 2),
             ("Detergent Pods, 20 ct per pack, 3 pack", 20.0, "pod", "count", "20 ct", 3), ("Napkins, 4 pack", 4.0, "each", "count", "4 pack", 4),
             ("Detergent Pods 42 ct, 2 pack", 42.0, "pod", "count", "42 ct", 2), ("Batteries (8 ct) 2 pack", 8.0, "each", "count", "8 ct", 2))
    k = (F.col("p_partkey") % len(cases) + 1).cast("int")
    pick = lambda i: F.element_at(F.array(*(F.lit(c[i]) for c in cases)), k)
    q = F.struct(pick(1).alias("value"), pick(2).alias("unit"), pick(3).alias("dimension"), pick(4).alias("source"))
    return table(spark, sf_dir, "part").select("p_partkey", normalize.pack_multiplier(pick(0), q, pick(5)).alias("times"))


@query(
    "native_matches",
    """SELECT p_partkey, p_partkey % 3 <> 1 AS same FROM part""",
)
def native_matches(spark, sf_dir):
    """Printed prices that already show what would be displayed."""
    k, cents = F.col("p_partkey") % 3, (F.col("p_size") + 1).cast("double")
    native = F.struct((cents + F.when(k == 1, 1.0).otherwise(0.0)).alias("cents"), F.lit("oz").alias("unit"), F.lit("mass").alias("dimension"))
    unit = F.when(k == 2, "fl_oz").otherwise("oz")
    shown = F.struct(unit.alias("unit"), F.when(k == 2, "volume").otherwise("mass").alias("dimension"), prices.format_price(cents, unit).alias("display"))
    return table(spark, sf_dir, "part").select("p_partkey", normalize.matching_native(native, F.struct(unit.alias("unit")), shown).alias("same"))


@query(
    "preferred_units",
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'kg' WHEN 1 THEN 'l' WHEN 2 THEN 'each' ELSE 'lb' END AS unit FROM customer""",
)
def preferred_units(spark, sf_dir):
    """Units by preference; what a preference does not name falls back."""
    source = F.element_at(F.array(*map(F.lit, ("oz", "ml", "each", "g"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    mine, plain = {"preferred_units": {"mass": "kg", "volume": "l", "count": "dozen"}}, {"preferred_units": {"mass": "stone"}}
    unit = F.when(F.col("c_custkey") % 4 == 3, units.target_unit(source, plain)).otherwise(units.target_unit(source, mine))
    return table(spark, sf_dir, "customer").select("c_custkey", unit.alias("unit"))


@query(
    "restored_order",
    """SELECT l_suppkey, l_orderkey, l_linenumber, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem GROUP BY ALL""",
)
def restored_order(spark, sf_dir):
    """H5, H6: rows back in their first order."""
    line = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey", "l_linenumber").agg(F.sum("l_quantity").cast("long").alias("quantity"))
    return compare.restore_order(line, ["l_suppkey", "l_orderkey"], "l_linenumber")


@query(
    "model_answers",
    """SELECT page_id, len(regexp_extract_all(html, '<li>')) AS nodes FROM pages WHERE contains(html, '<li>')""",
)
def model_answers(spark, sf_dir):
    """L1, L2: prompts of cards answered in batches (by a stand-in that counts nodes)."""
    n = html.page_nodes(table(spark, sf_dir, "pages")).where("tag = 'li'")
    asked = model.prompts(n, ["page_id"])
    told = model.answer(asked, lambda: lambda batch: [str(p.count('"node"')) for p in batch])
    return told.select("page_id", F.col("answer").cast("long").alias("nodes"))

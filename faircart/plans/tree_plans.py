"""Queries over page nodes, embedded products, generated targets and changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tree
from ..sources import files, generate, html
from ..streaming import sessions
from .common import dealt, registry, table

QUERIES, ORACLE_SQL, query = registry()


def nodes_of(spark, sf_dir):
    # Many pages of a small file are one split; dealt first, they are read by all cores.
    return html.page_nodes(dealt(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id"))


TAGS = ("li", "a", "h1", "nav", "article", "footer", "ul", "p", "b", "br")


@query(
    "html_nodes",
    "WITH t AS (SELECT page_id, html, unnest([" + ", ".join(f"'{t}'" for t in TAGS) + "]) AS tag FROM pages) "
    "SELECT page_id, tag, len(regexp_extract_all(html, concat('<', tag, '[ >/]'))) AS nodes FROM t WHERE len(regexp_extract_all(html, concat('<', tag, '[ >/]'))) > 0",
)
def html_nodes(spark, sf_dir):
    """Elements of every page, counted by tag."""
    return nodes_of(spark, sf_dir).where(F.col("tag").isin(*TAGS)).groupBy("page_id", "tag").agg(F.count("*").alias("nodes"))


@query(
    "node_children",
    "SELECT page_id, len(regexp_extract_all(html, '<li>')) AS items FROM pages WHERE contains(html, '<ul>')",
)
def node_children(spark, sf_dir):
    """Children of the list of links, in document order."""
    n = nodes_of(spark, sf_dir)
    lists = n.where("tag = 'ul'").select("page_id", F.col("node").alias("parent"))
    return tree.children(n).join(lists, ["page_id", "parent"]).groupBy("page_id").agg(F.sum("children").alias("items"))


@query(
    "node_ancestors",
    "SELECT page_id, len(regexp_extract_all(html, '<li>')) AS links, 3 AS nearest, 3 AS farthest FROM pages WHERE contains(html, '<li>')",
)
def node_ancestors(spark, sf_dir):
    """Links of the navigation with the distance to it."""
    n = nodes_of(spark, sf_dir)
    nav, link = n.where("tag = 'nav'").select("page_id", F.col("node").alias("ancestor")), n.where("tag = 'a'").select("page_id", "node")
    up = tree.ancestors(n).join(nav, ["page_id", "ancestor"]).join(link, ["page_id", "node"], "left_semi")
    return up.groupBy("page_id").agg(F.count("*").alias("links"), F.min("distance").cast("int").alias("nearest"), F.max("distance").cast("int").alias("farthest"))


ITEMS = """WITH i AS (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1)) AS t, generate_subscripts(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1), 1) AS k FROM pages)"""


@query("subtree_text", ITEMS + " SELECT page_id, k AS item, t AS text FROM i")
def subtree_text(spark, sf_dir):
    """The text of every list item's subtree."""
    n = nodes_of(spark, sf_dir)
    roots = n.where("tag = 'li'").select("page_id", F.col("node").alias("root"))
    from pyspark.sql import Window

    item = F.row_number().over(Window.partitionBy("page_id").orderBy("root")).cast("long")
    return tree.subtree_text(n, roots).select("page_id", item.alias("item"), "text")


@query(
    "independent_roots",
    "SELECT page_id, len(regexp_extract_all(html, '<li>')) AS roots FROM pages WHERE contains(html, '<li>')",
)
def independent_roots(spark, sf_dir):
    """Of navigations, lists and items only the items hold no other candidate."""
    n = nodes_of(spark, sf_dir)
    return tree.independent_roots(n, n.where("tag in ('nav', 'ul', 'li')")).groupBy("page_id").agg(F.count("*").alias("roots"))


@query(
    "comparison_scope",
    "SELECT page_id, len(regexp_extract_all(html, '<li>')) AS products, 'ul' AS scope FROM pages WHERE len(regexp_extract_all(html, '<li>')) >= 2",
)
def comparison_scope(spark, sf_dir):
    """The nearest node above a link that holds two or more of them in branches of its own."""
    n = nodes_of(spark, sf_dir)
    links = n.where("tag = 'li'").select("page_id", "node")
    found = tree.repeated_scope(n, links).join(n.select("page_id", F.col("node").alias("scope"), "tag"), ["page_id", "scope"])
    return found.groupBy("page_id", F.col("tag").alias("scope")).agg(F.count("*").alias("products"))


@query("sibling_xpath", ITEMS + " SELECT page_id, concat('/html[1]/body[1]/nav[1]/ul[1]/li[', k, ']/a[1]') AS xpath, t AS text FROM i")
def sibling_xpath(spark, sf_dir):
    """The path of every link with its numbers among siblings."""
    n = nodes_of(spark, sf_dir)
    return tree.with_xpath(n).join(n.where("tag = 'a'").select("page_id", "node", F.coalesce("text", F.lit("")).alias("text")), ["page_id", "node"]).select("page_id", "xpath", "text")


@query(
    "greedy_cards",
    "SELECT page_id, 'a' AS tag, len(regexp_extract_all(html, '<li>')) AS cards FROM pages WHERE contains(html, '<li>')",
)
def greedy_cards(spark, sf_dir):
    """Cards by score without overlaps."""
    n = nodes_of(spark, sf_dir)
    score = F.when(F.col("tag") == "a", 3).when(F.col("tag") == "li", 2).otherwise(1)
    scored = n.where("tag in ('nav', 'ul', 'li', 'a')").select("page_id", "node", score.alias("score"), F.length(F.coalesce("text", F.lit(""))).alias("length"))
    return tree.sorted_join(tree.greedy_cards(n, scored), n.select("page_id", "node", "tag"), ["page_id", "node"]).groupBy("page_id", "tag").agg(F.count("*").alias("cards"))


PRICE = "CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT)"


@query(
    "json_ld_products",
    f"""SELECT p_partkey AS page_id, CASE WHEN p_partkey % 5 = 2 THEN 'a page' ELSE p_name END AS title, {PRICE} AS cents FROM part WHERE p_partkey % 5 < 4
    UNION ALL SELECT p_partkey, 'second', NULL FROM part WHERE p_partkey % 5 = 1""",
)
def json_ld_products(spark, sf_dir):
    """Products and offer prices from embedded JSON."""
    price = F.format_string("%.2f", F.floor(F.col("p_retailprice") * 100 + 0.5) / 100)
    k = F.col("p_partkey") % 5
    own = lambda name, offers: F.concat(F.lit('{"@type": "Product", '), name, F.lit('"offers": '), offers, F.lit("}"))
    name, offer = F.concat(F.lit('"name": "'), "p_name", F.lit('", ')), F.concat(F.lit('{"price": "'), price, F.lit('"}'))
    body = (
        F.when(k == 0, own(name, offer))
        .when(k == 1, F.concat(F.lit('{"@graph": ['), own(name, F.concat(F.lit("["), offer, F.lit("]"))), F.lit(', {"@type": ["Thing", "product"], "headline": "second"}, {"@type": "Offer"}]}')))
        .when(k == 2, F.concat(F.lit("["), own(F.lit(""), offer), F.lit("]")))
        .when(k == 3, own(name, offer))
        .otherwise('{"@type": "Product", broken')
    )
    page = F.concat(F.lit('<html><head><title>a page</title><script type="application/ld+json">'), body, F.lit("</script></head></html>"))
    return html.json_ld_products(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), page.alias("html")))


@query(
    "capture_targets",
    """WITH q AS (SELECT s_name, unnest(['cat litter', 'Fl. Oz & more', 'cat-litter']) AS q FROM supplier),
    p AS (SELECT regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '--' || regexp_replace(regexp_replace(lower(q), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS page_id, q FROM q)
    SELECT page_id, count(*) > 1 AS repeated, min(replace(replace(url_encode(q), '%2D', '-'), '+', '%20')) AS query FROM p GROUP BY page_id""",
)
def capture_targets(spark, sf_dir):
    """A page for every site and query, with the ids that repeat."""
    queries = F.array(*map(F.lit, ("cat litter", "Fl. Oz & more", "cat-litter")))
    sites = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("site"), F.lit("shop.example").alias("host"), F.lit("https://shop.example/s?q={query}").alias("url"), queries.alias("queries"))
    pages, faults = generate.expand_targets(sites)
    flagged = pages.join(faults.withColumnRenamed("fault", "f"), "page_id", "left")
    return flagged.groupBy("page_id").agg(F.max(F.col("f").isNotNull()).alias("repeated"), F.min(F.regexp_extract("url", "q=(.*)$", 1)).alias("query"))


@query(
    "synthetic_products",
    """WITH p AS (SELECT i AS product, i // 20 AS page, i % 20 AS idx FROM range(20000) t(i))
    SELECT page, count_if(idx % 5 = 0) AS abstaining, CAST(sum(CASE WHEN idx % 4 = 3 THEN idx % 3 + 2 ELSE 1 END) AS BIGINT) AS packs, count_if(idx % 3 <> 0 AND idx % 7 = 2) AS rate_only,
      sum(CASE WHEN idx % 10 = 8 THEN 1.5 ELSE idx % 6 + 1 END)::DOUBLE AS quantity FROM p GROUP BY page""",
)
def synthetic_products(spark, sf_dir):
    """A10: generated products and the facts they must have."""
    p = generate.synthetic_products(spark, 20_000).groupBy("page")
    return p.agg(F.count_if("abstains").alias("abstaining"), F.sum("packs").alias("packs"), F.count_if("rate_only").alias("rate_only"), F.sum("quantity").alias("quantity"))


@query(
    "page_provenance",
    """SELECT page_id, 2 AS files, strlen(html) + strlen(url) AS bytes, sha256(concat('main.html', chr(0), strlen(html), chr(0), sha256(html), chr(10), 'url.txt', chr(0), strlen(url), chr(0), sha256(url), chr(10))) AS sha256
    FROM pages WHERE html IS NOT NULL AND url IS NOT NULL""",
)
def page_provenance(spark, sf_dir):
    """The digest of each page's files by name, size and digest."""
    p = table(spark, sf_dir, "pages").where("html is not null and url is not null")
    each = F.explode(F.array(F.struct(F.lit("main.html").alias("name"), F.col("html").alias("content")), F.struct(F.lit("url.txt").alias("name"), F.col("url").alias("content"))))
    rows = p.select("page_id", each.alias("f")).select("page_id", "f.name", "f.content")
    return files.provenance(rows, ["page_id"], "name", "content")


@query(
    "session_debounce",
    """WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new
      FROM events WHERE event_type IN ('click', 'error')), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e)
    SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 30 MINUTE AS due, count(*) AS changes FROM s GROUP BY user_id, n""",
)
def session_debounce(spark, sf_dir):
    """K1, K2: one rescan after each run of changes that a pause ends (half an hour, as these events are sparse)."""
    t = F.when(F.col("event_type") == "click", "now $ 5").when(F.col("event_type") == "error", "a 12 fl oz can").otherwise("nothing new")
    changes = sessions.product_changes(table(spark, sf_dir, "events").withColumn("text", t))
    return sessions.debounced(changes, "user_id", gap="30 minutes")


@query(
    "status_publication",
    "SELECT user_id, count(*) AS products, count(*) >= 2 AS sortable FROM events GROUP BY user_id",
)
def status_publication(spark, sf_dir):
    """K3: the running state of each page."""
    return sessions.status_counts(table(spark, sf_dir, "events"), "user_id", "event_type").select("user_id", "products", "sortable")

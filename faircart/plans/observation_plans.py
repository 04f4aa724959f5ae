"""Queries over views of shelf pages: crops, budgets, siblings, roots, markup and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import observation
from ..operators.tree import sorted_join
from .common import registry, table
from .shelves import SHELF_SQL, shelf_nodes, shelf_regions, shelf_tasks

QUERIES, ORACLE_SQL, query = registry()

#: Every node with itself and all nodes above it.
CLOSURE = "up AS (SELECT page_id, node, node AS top FROM n UNION ALL SELECT up.page_id, up.node, n.parent FROM up JOIN n ON n.page_id = up.page_id AND n.node = up.top WHERE n.parent IS NOT NULL)"


@query(
    "observation_crop",
    f"""WITH RECURSIVE {SHELF_SQL}, {CLOSURE},
    r AS (SELECT page_id, page_id % 3 * 330.0 AS x, 100.0 AS y, 340.0 AS w, 300.0 + page_id % 7 * 100 AS h FROM n WHERE node = 0),
    k AS (SELECT DISTINCT up.page_id, up.top FROM n JOIN r USING (page_id) JOIN up ON up.page_id = n.page_id AND up.node = n.node
      WHERE n.x < r.x + r.w AND n.x + n.w > r.x AND n.y < r.y + r.h AND n.y + n.h > r.y)
    SELECT page_id, count(*) AS nodes, CAST(sum(top) AS BIGINT) AS ids FROM k GROUP BY page_id""",
)
def observation_crop(spark, sf_dir):
    """What a window of each shelf shows, with the nodes above it."""
    n = shelf_nodes(spark, sf_dir)
    i = F.col("page_id")
    r = shelf_regions(n).select("page_id", F.lit(0).alias("view"), (i % 3 * 330.0).alias("x"), F.lit(100.0).alias("y"), F.lit(340.0).alias("w"), (i % 7 * 100 + 300.0).alias("h"))
    return observation.crop(n, r, shelf_tasks(spark, sf_dir)).groupBy("page_id").agg(F.count("*").alias("nodes"), F.sum("node").alias("ids"))


@query("observation_prune")
def observation_prune(spark, sf_dir):
    """Each shelf cut to 24 nodes around the card at place 5 (greedy, so without SQL; tested against brute force)."""
    n = shelf_nodes(spark, sf_dir)
    card = shelf_regions(n).select("page_id", F.lit(42).alias("node"))
    return observation.prune(n, 24, required=card).select("page_id", "node", "cut")


SCORE = "(p_partkey * 7 % 11) / 10.0"


@query(
    "sibling_completion",
    f"""WITH RECURSIVE {SHELF_SQL}, {CLOSURE},
    e AS (SELECT DISTINCT up.page_id, up.top AS node FROM n JOIN up USING (page_id, node) WHERE trim(coalesce(text, '')) <> '' OR trim(coalesce(label, '')) <> ''),
    s AS (SELECT page_id, b AS node, {SCORE} AS score FROM p UNION ALL SELECT page_id, b + 3, 0.9 FROM p WHERE form = 4),
    k AS (SELECT n.*, score FROM n JOIN s USING (page_id, node) SEMI JOIN e USING (page_id, node) WHERE x + w / 2 BETWEEN 0 AND 800),
    a AS (SELECT page_id, parent, min(node) AS node FROM k WHERE score >= 0.7 GROUP BY ALL HAVING count(*) >= 2),
    m AS (SELECT k.page_id, k.node FROM k JOIN a USING (page_id, parent) JOIN n f ON f.page_id = a.page_id AND f.node = a.node
      WHERE k.score >= 0.3 AND k.tag = f.tag AND least(k.w, f.w) / greatest(k.w, f.w) >= 0.8 AND least(k.h, f.h) / greatest(k.h, f.h) >= 0.7)
    SELECT k.page_id, k.node, k.score >= 0.7 AS anchored FROM k LEFT JOIN m ON m.page_id = k.page_id AND m.node = k.node WHERE k.score >= 0.7 OR m.node IS NOT NULL""",
)
def sibling_completion(spark, sf_dir):
    """Scored cards, and siblings of the same shape."""
    n = shelf_nodes(spark, sf_dir)
    p = table(spark, sf_dir, "part").withColumn("page_id", F.expr("p_partkey div 8")).withColumn("b", F.expr("cast(2 + 8 * (p_partkey % 8) as int)"))
    s = p.select("page_id", F.col("b").alias("node"), F.expr(SCORE).cast("double").alias("score"))
    s = s.unionByName(p.where("p_partkey % 5 = 4").select("page_id", F.expr("b + 3").alias("node"), F.lit(0.9).alias("score")))
    r = shelf_regions(n).withColumn("w", F.lit(800.0))
    return observation.complete_siblings(n, s, r, 0.7).select("page_id", "node", "anchored")


CITED = "SELECT page_id, b + 1 AS node FROM p WHERE p_partkey % 3 <> 0 UNION SELECT page_id, b + 2 FROM p WHERE form = 1 UNION SELECT page_id, b + 4 FROM p WHERE form = 2"


@query(
    "card_roots",
    f"""WITH RECURSIVE {SHELF_SQL}, {CLOSURE}, e AS ({CITED}),
    fit AS (SELECT * FROM n WHERE y + h / 2 >= 0 AND y + h / 2 < 1400 AND w >= 80 AND w <= 650 AND h >= 100 AND h <= 2100),
    c AS (SELECT up.page_id, up.node, fit.node AS root, fit.tag, fit.role, fit.w, fit.h FROM e JOIN up USING (page_id, node) JOIN fit ON fit.page_id = up.page_id AND fit.node = up.top),
    held AS (SELECT page_id, top AS root, count(*) AS held FROM e JOIN up USING (page_id, node) GROUP BY ALL),
    sem AS (SELECT page_id, node, max(root) AS root FROM c WHERE role = 'listitem' OR tag IN ('li', 'article') GROUP BY ALL),
    alone AS (SELECT c.*, (SELECT count(*) FROM fit f WHERE f.page_id = c.page_id AND f.node <> c.root AND f.tag = c.tag AND f.role IS NOT DISTINCT FROM c.role
        AND least(f.w, c.w) / greatest(f.w, c.w) >= 0.8 AND least(f.h, c.h) / greatest(f.h, c.h) >= 0.7) AS peers
      FROM c JOIN held USING (page_id, root) ANTI JOIN sem USING (page_id, node) WHERE held = 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY page_id, node ORDER BY peers DESC, w * h DESC, root) AS r FROM alone)
    SELECT page_id, node, root FROM sem UNION ALL SELECT page_id, node, root FROM r WHERE r = 1""",
)
def card_roots(spark, sf_dir):
    """The card around each cited title, picture or price."""
    n = shelf_nodes(spark, sf_dir)
    p = table(spark, sf_dir, "part").select("p_partkey", F.expr("p_partkey div 8 as page_id"), F.expr("cast(2 + 8 * (p_partkey % 8) as int) as b"))
    one = lambda where, k: p.where(where).select("page_id", F.expr(f"b + {k}").alias("node"))
    cited = one("p_partkey % 3 <> 0", 1).unionByName(one("p_partkey % 5 = 1", 2)).unionByName(one("p_partkey % 5 = 2", 4))
    return observation.card_roots(n, cited, shelf_regions(n), shelf_tasks(spark, sf_dir))


@query(
    "markup_titles",
    f"""WITH {SHELF_SQL}, t AS (SELECT DISTINCT page_id, p_name AS title FROM p WHERE p_partkey % 8 < 5),
    m AS (SELECT t.page_id, t.title, min(n.node) AS node FROM t JOIN n ON n.page_id = t.page_id AND n.tag = 'img' AND (contains(n.label, t.title) OR contains(t.title, n.label)) GROUP BY ALL),
    held AS (SELECT page_id, (node - 2) // 8 * 8 + 2 AS card FROM m)
    SELECT t.page_id, count(*) + 1 AS titles, count(*) AS matched, 1 AS unmatched, (SELECT list(DISTINCT card ORDER BY card) FROM held WHERE held.page_id = t.page_id)::VARCHAR AS cards FROM t GROUP BY t.page_id""",
)
def markup_titles(spark, sf_dir):
    """Titles that a model of pictures wrote as markup, mapped to cards; one of each page stands nowhere."""
    n = shelf_nodes(spark, sf_dir)
    part = table(spark, sf_dir, "part").where("p_partkey % 8 < 5").select(F.expr("p_partkey div 8").alias("page_id"), "p_name")
    text = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list("p_name")), lambda x: F.concat(F.lit("<div <img_alt= "), x, F.lit(">>"))), " "), F.lit(" <img_alt=zebra quilt> <img_alt=one>"))
    found = observation.map_titles(n, part.groupBy("page_id").agg(text.alias("markup")), shelf_regions(n), shelf_tasks(spark, sf_dir))
    return found.select("page_id", "titles", "matched", "unmatched", F.concat(F.lit("["), F.array_join("cards", ", "), F.lit("]")).alias("cards"))


@query(
    "discovery_prompts",
    f"""WITH RECURSIVE {SHELF_SQL}, {CLOSURE}, r AS (SELECT page_id, v.view, v.view * 400.0 AS y, least(400.0, 1400.0 - v.view * 400) AS h FROM n, (SELECT unnest([0, 1, 2, 3]) AS view) v WHERE node = 0),
    k AS (SELECT DISTINCT r.page_id, r.view, up.top AS node FROM n JOIN r USING (page_id) JOIN up ON up.page_id = n.page_id AND up.node = n.node WHERE n.y < r.y + r.h AND n.y + n.h > r.y)
    SELECT k.page_id, k.view, count(*) AS nodes, CAST(sum(node) AS BIGINT) AS ids, count(text) AS texts, count_if(interactive) AS actions, sum(w) AS width, sum(r.depth) AS depths, (k.view * 400)::BIGINT AS top
    FROM k JOIN n USING (page_id, node) JOIN (SELECT page_id, node, count(*) AS depth FROM up GROUP BY ALL) r USING (page_id, node) GROUP BY k.page_id, k.view""",
)
def discovery_prompts(spark, sf_dir):
    """Bands of each shelf as prompts, and the node tables read back from them."""
    n = shelf_nodes(spark, sf_dir)
    regions = shelf_regions(n)
    views = observation.discovery_regions(regions, 400.0)
    asked = observation.prompts(observation.crop(n, views), views, "discover-products", "Name the nodes that are whole product cards.")
    back = observation.parse_prompts(asked, ["page_id", "view"]).groupBy("page_id", "view").agg(
        F.count("*").alias("nodes"), F.sum("node").alias("ids"), F.count("text").alias("texts"), F.count_if("interactive").alias("actions"), F.sum("w").alias("width"), F.sum(F.size("path")).alias("depths")
    )
    return sorted_join(back, observation.relative_crop(views, regions).select("page_id", "view", "top"), ["page_id", "view"])


@query(
    "extraction_prompts",
    f"""WITH RECURSIVE {SHELF_SQL}, {CLOSURE}, c AS (SELECT page_id, node AS view, greatest(0, x - 24) AS l, greatest(0, y - 24) AS t, least(1000, x + w + 24) AS r, least(1400, y + h + 24) AS b FROM n WHERE node % 8 = 2),
    k AS (SELECT DISTINCT c.page_id, c.view, up.top FROM n JOIN c USING (page_id) JOIN up ON up.page_id = n.page_id AND up.node = n.node WHERE n.x < r AND n.x + n.w > l AND n.y < b AND n.y + n.h > t)
    SELECT c.page_id, c.view, any_value(floor(l))::BIGINT AS "left", any_value(ceil(r) - floor(l))::BIGINT AS width, any_value(ceil(b) - floor(t))::BIGINT AS height, count(*)::INTEGER AS nodes FROM c JOIN k USING (page_id, view) GROUP BY c.page_id, c.view""",
)
def extraction_prompts(spark, sf_dir):
    """A prompt for each card, with the crop of the page's picture."""
    n = shelf_nodes(spark, sf_dir)
    regions = shelf_regions(n)
    views = observation.extraction_regions(n, n.where("node % 8 = 2"), regions)
    asked = observation.prompts(observation.crop(n, views), views, "extract-product", "Name the evidence of this card.")
    return sorted_join(asked, observation.relative_crop(views, regions), ["page_id", "view"]).select("page_id", "view", "left", "width", "height", "nodes")

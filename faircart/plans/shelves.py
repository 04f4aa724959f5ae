"""Shelf pages that queries derive from ``part``: eight cards a page, with bounds, roles and three layouts; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SQL_MACROS, cents_of, dollars, table, tasks_for

#: Node numbers of a card start at 2 + 8 * its place.
SHELF = "page_id long, node int, path array<int>, tag string, role string, text string, label string, interactive boolean, x double, y double, w double, h double"


def shelf_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node table of all shelves: lists, grids and articles by page, price lines in five forms by part."""
    page, place = F.expr("p_partkey div 8"), F.expr("cast(p_partkey % 8 as int)")
    # A small file is few splits; dealt by page first, its nodes are made by all cores.
    p, cents = table(spark, sf_dir, "part").repartition(page), cents_of(F.col("p_retailprice"))
    form, layout = F.col("p_partkey") % 5, F.expr("p_partkey div 8 % 3")
    tag = F.when(layout == 0, "li").when(layout == 1, "div").otherwise("article")
    size = F.concat("p_size", F.when(F.col("p_partkey") % 4 == 3, F.lit(" ct")).otherwise(F.lit(" oz")))
    more = (
        F.when(form == 0, F.concat(F.lit("("), dollars(F.expr("p_size + 100")), F.lit("/oz)")))
        .when(form == 1, F.concat(F.lit("was "), dollars(cents + 250)))
        .when(form == 2, F.lit("per sq ft"))
        .when(form == 3, F.lit("pack of 4"))
    )
    base = (2 + 8 * F.col("place")).cast("int")
    left, top = F.lit(10.0) + F.col("place") % 3 * 330, F.lit(100.0) + F.expr("place div 3") * 400
    wide, high = F.lit(300.0) + F.col("p_size") % 3 * 5, F.lit(320.0) + F.col("p_partkey") % 2 * 10

    def node(k, depth, tag, role=None, text=None, label=None, interactive=False, box=(left, top, wide, high)):
        path = [F.lit(0), F.lit(1), base, base + 3] if depth == 4 else [F.lit(0), F.lit(1), base]
        path = F.array(*path) if k == 0 else F.array(*path, base + k)
        name = ("node", "path", "tag", "role", "text", "label", "interactive", "x", "y", "w", "h")
        value = (base + k, path, tag, role, text, label, F.lit(interactive), *(b.cast("double") for b in box))
        return F.struct(*((F.lit(v).cast("string") if v is None or isinstance(v, str) else v).alias(n) for n, v in zip(name, value, strict=True)))

    inner = wide - 20
    nodes = F.array(
        node(0, 3, tag, F.when(layout == 0, "listitem")),
        node(1, 3, "a", text=F.concat("p_name", F.lit(", "), size), box=(left + 10, top + 10, inner, F.lit(40))),
        node(2, 3, "img", label=F.col("p_name"), box=(left + 10, top + 60, inner, F.lit(120))),
        node(3, 3, "div", box=(left + 10, top + 190, inner, F.lit(80))),
        node(4, 4, "span", text=dollars(cents), box=(left + 10, top + 190, F.lit(100), F.lit(30))),
        node(5, 4, "span", text=more, box=(left + 120, top + 190, F.lit(100), F.lit(30))),
        node(6, 3, "button", text=F.lit("Add to cart"), interactive=True, box=(left + 10, top + 280, inner, F.lit(30))),
    )
    cards = p.withColumn("page_id", page).withColumn("place", place).select("page_id", F.explode(nodes).alias("n")).select("page_id", "n.*").where("tag <> 'span' or text is not null")
    pages = p.select(page.alias("page_id")).distinct()
    holder = F.expr("case page_id % 3 when 0 then 'ul' when 1 then 'div' else 'section' end")
    frame = F.array(
        F.struct(F.lit(0).alias("node"), F.array(F.lit(0)).alias("path"), F.lit("body").alias("tag"), F.lit(0.0).alias("y"), F.lit(1400.0).alias("h")),
        F.struct(F.lit(1).alias("node"), F.array(F.lit(0), F.lit(1)).alias("path"), holder.alias("tag"), F.lit(90.0).alias("y"), F.lit(1300.0).alias("h")),
    )
    none = F.lit(None).cast("string")
    frames = pages.select("page_id", F.explode(frame).alias("f")).select(
        "page_id", "f.node", "f.path", "f.tag", none.alias("role"), none.alias("text"), none.alias("label"), F.lit(False).alias("interactive"), F.lit(0.0).alias("x"), "f.y", F.lit(1000.0).alias("w"), "f.h"
    )
    return frames.unionByName(cards)


#: Parts whose nodes one task sorts together, on average at most; a part has up to seven nodes.
TASK_PARTS = 20_000


def shelf_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks for joins of all shelves' nodes: they grow with ``part``, so that the memory of one does not."""
    return tasks_for(table(spark, sf_dir, "part"), TASK_PARTS)


def shelf_regions(nodes: DataFrame) -> DataFrame:
    """``(page_id, x, y, w, h)`` of each page's root."""
    return nodes.where("node = 0").select("page_id", "x", "y", "w", "h")


_cents, _dollars = SQL_MACROS["cents"]("p_retailprice"), SQL_MACROS["dollars"]

#: The node table (with ``parent`` instead of paths) for DuckDB, to follow WITH; later steps are appended to it.
SHELF_SQL = f"""p AS (SELECT *, p_partkey // 8 AS page_id, p_partkey % 8 AS k, p_partkey // 8 % 3 AS layout, p_partkey % 5 AS form, {_cents} AS cents, 2 + 8 * (p_partkey % 8) AS b,
    (10 + p_partkey % 8 % 3 * 330)::DOUBLE AS px, (100 + p_partkey % 8 // 3 * 400)::DOUBLE AS py, (300 + p_size % 3 * 5)::DOUBLE AS pw, (320 + p_partkey % 2 * 10)::DOUBLE AS ph FROM part),
  n AS (
    SELECT DISTINCT page_id, 0 AS node, NULL::BIGINT AS parent, 'body' AS tag, NULL AS role, NULL AS text, NULL AS label, false AS interactive, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 1000.0::DOUBLE AS w, 1400.0::DOUBLE AS h FROM p
    UNION ALL SELECT DISTINCT page_id, 1, 0, CASE layout WHEN 0 THEN 'ul' WHEN 1 THEN 'div' ELSE 'section' END, NULL, NULL, NULL, false, 0.0, 90.0, 1000.0, 1300.0 FROM p
    UNION ALL SELECT page_id, b, 1, CASE layout WHEN 0 THEN 'li' WHEN 1 THEN 'div' ELSE 'article' END, CASE layout WHEN 0 THEN 'listitem' END, NULL, NULL, false, px, py, pw, ph FROM p
    UNION ALL SELECT page_id, b + 1, b, 'a', NULL, p_name || ', ' || p_size || CASE p_partkey % 4 WHEN 3 THEN ' ct' ELSE ' oz' END, NULL, false, px + 10, py + 10, pw - 20, 40 FROM p
    UNION ALL SELECT page_id, b + 2, b, 'img', NULL, NULL, p_name, false, px + 10, py + 60, pw - 20, 120 FROM p
    UNION ALL SELECT page_id, b + 3, b, 'div', NULL, NULL, NULL, false, px + 10, py + 190, pw - 20, 80 FROM p
    UNION ALL SELECT page_id, b + 4, b + 3, 'span', NULL, {_dollars("cents")}, NULL, false, px + 10, py + 190, 100, 30 FROM p
    UNION ALL SELECT page_id, b + 5, b + 3, 'span', NULL, CASE form WHEN 0 THEN '(' || {_dollars("(p_size + 100)")} || '/oz)' WHEN 1 THEN 'was ' || {_dollars("(cents + 250)")} WHEN 2 THEN 'per sq ft' ELSE 'pack of 4' END, NULL, false, px + 120, py + 190, 100, 30 FROM p WHERE form < 4
    UNION ALL SELECT page_id, b + 6, b, 'button', NULL, 'Add to cart', NULL, true, px + 10, py + 280, pw - 20, 30 FROM p)"""

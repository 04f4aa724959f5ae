"""Operators over the node table: ancestors by materialised paths, so that no step recurses or walks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = "page_id"


def spread(rows: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """``rows`` over ``tasks`` by ``keys``; as they are without a number."""
    return rows if tasks is None else rows.repartition(tasks, *keys)


def sorted_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner", tasks: int | None = None) -> DataFrame:
    """``left`` joined with ``right`` by sorted shuffles, never by a broadcast.

    Nodes are exploded from files that are far smaller. Spark judges them by the files' size and would send millions of rows
    through the driver. A number of ``tasks`` that grows with the nodes keeps what one of them sorts the same.
    """
    if tasks is not None:
        keys = [on] if isinstance(on, str) else on
        left, right = spread(left, tasks, *keys), spread(right, tasks, *keys)
    return left.hint("merge").join(right.hint("merge"), on, how)


def children(nodes: DataFrame) -> DataFrame:
    """``(page_id, parent, children, first, last)`` of every node that has children; order is that of the document."""
    parent = F.try_element_at("path", F.lit(-2))
    rows = nodes.select(PAGE, parent.alias("parent"), "node").where("parent is not null")
    return rows.groupBy(PAGE, "parent").agg(F.count("*").alias("children"), F.min("node").alias("first"), F.max("node").alias("last"))


def ancestors(nodes: DataFrame) -> DataFrame:
    """``(page_id, node, ancestor, distance)``: every node with itself and all nodes above it."""
    depth = F.size("path")
    rows = nodes.select(PAGE, "node", depth.alias("depth"), F.posexplode("path").alias("at", "ancestor"))
    return rows.select(PAGE, "node", "ancestor", (F.col("depth") - 1 - F.col("at")).alias("distance"))


def own_text(text: Column, label: Column) -> Column:
    """A node's own distinct strings."""
    return F.array_join(F.array_distinct(F.filter(F.array(text, label), lambda x: x.isNotNull() & (x != ""))), " ")


def subtree_text(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``(page_id, root, text, descendants)`` of ``roots(page_id, root)``: own texts and labels below each, in document order."""
    rows = nodes.select(PAGE, "node", own_text(F.col("text"), F.col("label")).alias("own"), F.explode("path").alias("root"))
    rows = sorted_join(rows, roots.select(PAGE, "root").distinct(), [PAGE, "root"], "left_semi")
    parts = F.transform(F.sort_array(F.collect_list(F.when(F.col("own") != "", F.struct("node", "own")))), lambda x: x["own"])
    return rows.groupBy(PAGE, "root").agg(F.array_join(parts, " ").alias("text"), (F.count("*") - 1).alias("descendants"))


def independent_roots(nodes: DataFrame, candidates: DataFrame) -> DataFrame:
    """``candidates(page_id, node)`` that are no ancestor of another candidate, each once."""
    own = candidates.select(PAGE, "node").distinct()
    above = sorted_join(nodes, own, [PAGE, "node"], "left_semi").select(PAGE, F.explode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("node"))
    return sorted_join(own, above.distinct(), [PAGE, "node"], "left_anti")


def repeated_scope(nodes: DataFrame, products: DataFrame, least: int = 2, most: int | None = None) -> DataFrame:
    """``(page_id, node, scope)``: for each product the nearest node above it with ``least`` children or more that hold products.

    A product without such a node is left out; ``most`` bounds the children from above.
    """
    rows = sorted_join(nodes, products.select(PAGE, "node").distinct(), [PAGE, "node"], "left_semi").select(PAGE, "node", "path")
    steps = rows.select(PAGE, "node", F.posexplode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("at", "scope"), "path")
    steps = steps.select(PAGE, "node", "scope", "at", F.element_at("path", F.col("at") + 2).alias("branch"))
    branches = steps.select(PAGE, "scope", "branch").distinct().groupBy(PAGE, "scope").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    if most is not None:
        branches = branches.where(F.col("n") <= most)
    return sorted_join(steps, branches, [PAGE, "scope"]).groupBy(PAGE, "node").agg(F.max(F.struct("at", "scope"))["scope"].alias("scope"))


def with_xpath(nodes: DataFrame) -> DataFrame:
    """``(page_id, node, xpath)``: tags from the root down, each with its number among siblings of its tag."""
    parent = F.coalesce(F.try_element_at("path", F.lit(-2)), F.lit(-1))
    w = Window.partitionBy(PAGE, "parent", "tag").orderBy("node")
    steps = nodes.withColumn("parent", parent).withColumn("step", F.concat(F.lit("/"), "tag", F.lit("["), F.row_number().over(w), F.lit("]")))
    up = nodes.select(PAGE, "node", F.posexplode("path").alias("at", "above"))
    joined = sorted_join(up, steps.select(PAGE, F.col("node").alias("above"), "step"), [PAGE, "above"])
    parts = F.transform(F.sort_array(F.collect_list(F.struct("at", "step"))), lambda x: x["step"])
    return joined.groupBy(PAGE, "node").agg(F.array_join(parts, "").alias("xpath"))


def evidence_distance(nodes: DataFrame, cited: DataFrame) -> DataFrame:
    """``(page_id, node, distance)``: how far below a candidate the nearest cited node is, 0 for itself; absent if none is below."""
    return sorted_join(ancestors(nodes), cited.select(PAGE, "node").distinct(), [PAGE, "node"], "left_semi").groupBy(PAGE, F.col("ancestor").alias("node")).agg(F.min("distance").alias("distance"))


def greedy_cards(nodes: DataFrame, scored: DataFrame) -> DataFrame:
    """``(page_id, node)`` accepted from ``scored(page_id, node, score, length)``: by score, then shorter text, none above or below another.

    The choice depends on its order, so each page is walked by itself. Subtrees are ranges of nodes that nest or lie apart, so
    the last one accepted that begins within a candidate's range or before it decides; no paths are held.
    """
    import pandas as pd

    rows = sorted_join(nodes.select(PAGE, "node", "last"), scored, [PAGE, "node"])

    def choose(page: pd.DataFrame) -> pd.DataFrame:
        from bisect import bisect_right

        first, last = [], []
        for r in page.sort_values(["score", "length", "node"], ascending=[False, True, True]).itertuples():
            at = bisect_right(first, r.last)
            if at == 0 or last[at - 1] < r.node:
                first.insert(at, r.node)
                last.insert(at, r.last)
        return pd.DataFrame({PAGE: page[PAGE].iloc[:1].repeat(len(first)).to_numpy(), "node": first})

    return rows.groupBy(PAGE).applyInPandas(choose, f"{PAGE} long, node int")

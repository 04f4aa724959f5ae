"""Views of rendered pages: crops, pruning to a budget, card roots, completed siblings, prompts and back.

A node table here has ``(page_id, node, path, tag, role, text, label, interactive, x, y, w, h)``: ``node`` counts in document
order, ``path`` lists the nodes from the root down to the node itself. A view is one part of a page that a model is to see.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import squeezed_alnum, squeezed_similarity, word_set
from .tree import PAGE, sorted_join, spread

BOX = ("x", "y", "w", "h")

# Points of a node that a model should see, by pattern.
SIGNAL_PRICE = r"(?i)[$€£]\s*\d|\d[\d,.]*\s*¢"
SIGNAL_SIZE = r"(?i)\b\d+(?:\.\d+)?\s*(?:fl\s*oz|ounces?|oz|pounds?|lbs?|grams?|kg|ml|liters?|litres?|count|ct|pack|pk|each|ea)\b"
SIGNAL_ACTION = r"(?i)\b(?:add|buy|cart|select|choose)\b"
#: A sibling joins from this score on, if its width and height are as near as this to the anchor's.
SIBLING_SCORE, NEAR_WIDTH, NEAR_HEIGHT = 0.30, 0.8, 0.7
#: Fixed value: similarity from which a node's string is evidence of a title.
EVIDENCE = 0.58


def region_columns(regions: DataFrame) -> DataFrame:
    """``regions`` with their box renamed to rx, ry, rw and rh."""
    return regions.withColumnsRenamed({c: f"r{c}" for c in BOX})


def crop(nodes: DataFrame, regions: DataFrame, tasks: int | None = None) -> DataFrame:
    """``nodes`` with ``view``: those that meet a region of ``regions(page_id, view, x, y, w, h)``, and all above them.

    Touching edges don't meet. A node stands once in each view; pages without a region give nothing. ``tasks`` is that of ``sorted_join``.
    """
    met = sorted_join(nodes, region_columns(regions), PAGE, tasks=tasks).where("x < rx + rw and x + w > rx and y < ry + rh and y + h > ry")
    keep = met.select(PAGE, "view", F.explode("path").alias("node")).distinct()
    return sorted_join(nodes, keep, [PAGE, "node"], tasks=tasks)


def signal_score(nodes: DataFrame) -> Column:
    """How much a model needs to see a node: prices, sizes, headings and images, links, actions, short texts."""
    content = F.trim(F.concat_ws(" ", *(F.when(F.col(c) != "", F.col(c)) for c in ("text", "label"))))
    points = (
        (100, content.rlike(SIGNAL_PRICE)),
        (80, content.rlike(SIGNAL_SIZE)),
        (35, F.col("tag").rlike("(?i)^(?:h[1-6]|img)$")),
        (30, (F.col("tag") == "a") & (content != "")),
        (25, F.col("interactive") & content.rlike(SIGNAL_ACTION)),
        (10, F.length(content).between(4, 240)),
    )
    return reduce(lambda a, b: a + b, [F.when(F.coalesce(c, F.lit(False)), n).otherwise(0) for n, c in points])


def prune(nodes: DataFrame, budget: int, by: tuple[str, ...] = (PAGE,), required: DataFrame | None = None, subtrees: DataFrame | None = None) -> DataFrame:
    """``nodes`` of each group ``by``, cut to ``budget``, with ``cut``: whether any are missing.

    Groups within the budget stay whole. Else the root, the paths to ``required(by, node)`` and everything below
    ``subtrees(by, node)`` (the required ones, if not given) stay even beyond the budget. Then paths to nodes are added by
    score, if they fit, and children of what is there in document order. Ids that a group doesn't have are ignored.
    The choice depends on its order; a group is one view of a page and is walked by itself.
    """
    import pandas as pd

    keys = [*by]
    must = nodes.where(F.size("path") == 1).select(*keys, "node")
    if required is not None:
        paths = sorted_join(nodes, required.select(*keys, "node").distinct(), [*keys, "node"], "left_semi")
        must = must.unionByName(paths.select(*keys, F.explode("path").alias("node")))
    subtrees = required if subtrees is None else subtrees
    if subtrees is not None:
        tops = subtrees.select(*keys, "node").distinct()
        at = sorted_join(nodes, tops, [*keys, "node"], "left_semi").select(*keys, F.explode("path").alias("node"))
        below = sorted_join(nodes.select(*keys, "node", F.explode("path").alias("top")), tops.withColumnRenamed("node", "top"), [*keys, "top"], "left_semi")
        must = must.unionByName(at).unionByName(below.select(*keys, "node"))
    must = must.distinct().withColumn("need", F.lit(True))
    ranked = sorted_join(nodes.select(*keys, "node", "path", signal_score(nodes).alias("score")), must, [*keys, "node"], "left")

    def choose(view: pd.DataFrame) -> pd.DataFrame:
        view = view.sort_values("node")
        paths = {n: [int(i) for i in p] for n, p in zip(view["node"], view["path"], strict=True)}
        kept = set(view["node"][view["need"].notna()]) if len(view) > budget else set(paths)
        for n in view[view["score"] > 0].sort_values(["score", "node"], ascending=[False, True])["node"]:
            if len(kept) >= budget:
                break
            path = [i for i in paths[n] if i in paths and i not in kept]
            if len(kept) + len(path) <= budget:
                kept.update(path)
        for n, path in paths.items():
            if len(kept) >= budget:
                break
            if len(path) > 1 and path[-2] in kept:
                kept.add(n)
        out = view[view["node"].isin(kept)][[*keys, "node"]]
        return out.assign(cut=len(kept) < len(view))

    kinds = dict(nodes.dtypes)
    kept = ranked.groupBy(*keys).applyInPandas(choose, ", ".join(f"{k} {kinds[k]}" for k in [*keys, "node"]) + ", cut boolean")
    return sorted_join(nodes, kept, [*keys, "node"])


def has_evidence(nodes: DataFrame) -> DataFrame:
    """``(page_id, node)`` of nodes with a text or label of their own or anywhere below."""
    own = nodes.where((F.trim(F.coalesce("text", F.lit(""))) != "") | (F.trim(F.coalesce("label", F.lit(""))) != ""))
    return own.select(PAGE, F.explode("path").alias("node")).distinct()


def nearness(left: Column, right: Column) -> Column:
    """The smaller over the larger; null where both are zero."""
    return F.try_divide(F.least(left, right), F.greatest(left, right))


def complete_siblings(nodes: DataFrame, scores: DataFrame, regions: DataFrame, threshold: float, least: float = SIBLING_SCORE) -> DataFrame:
    """``(page_id, node, score, anchored)``: cards by model scores, with siblings that look like them.

    Of ``scores(page_id, node, score)`` those take part whose centre lies in the region's columns and that hold evidence. From
    ``threshold`` on they are cards; where a parent has two or more, others of it join from ``least`` on, if tag and shape are
    those of the parent's first card. One window over parents; no pairs are made.
    """
    known = sorted_join(sorted_join(nodes, scores, [PAGE, "node"]), has_evidence(nodes), [PAGE, "node"], "left_semi")
    known = sorted_join(known, region_columns(regions), PAGE)
    known = known.where("x + w / 2 >= rx and x + w / 2 <= rx + rw").withColumn("parent", F.try_element_at("path", F.lit(-2)))
    sure = F.coalesce(F.col("score") >= threshold, F.lit(False))
    siblings = Window.partitionBy(PAGE, "parent")
    anchor = F.min(F.when(sure, F.struct("node", "tag", "w", "h"))).over(siblings)
    known = known.withColumn("sure", sure).withColumn("anchor", anchor).withColumn("anchors", F.count_if("sure").over(siblings))
    alike = (F.col("tag") == F.col("anchor.tag")) & (nearness(F.col("w"), F.col("anchor.w")) >= NEAR_WIDTH) & (nearness(F.col("h"), F.col("anchor.h")) >= NEAR_HEIGHT)
    joins = F.col("parent").isNotNull() & (F.col("anchors") >= 2) & alike & (F.col("score") >= least)
    return known.where(F.col("sure") | joins).select(PAGE, "node", "score", F.col("sure").alias("anchored"))


def plausible_root() -> Column:
    """Whether a node, with its page's region beside it, can be a card's root by place and size."""
    return F.expr("y + h / 2 >= ry and y + h / 2 < ry + rh and w >= 80 and w <= rw * 0.65 and h >= 100 and h <= rh * 1.5")


def card_roots(nodes: DataFrame, evidence: DataFrame, regions: DataFrame, tasks: int | None = None) -> DataFrame:
    """``(page_id, node, root)``: the card that each node of ``evidence(page_id, node)`` stands in; none without a plausible one.

    The nearest plausible list item or article above it (or itself); else, of the plausible ones that hold no other evidence,
    the one most often repeated on the page, then the largest, then the first. ``tasks`` is that of ``sorted_join``.
    """
    cited = spread(evidence.select(PAGE, "node"), tasks, PAGE, "node").distinct()
    up = sorted_join(nodes, cited, [PAGE, "node"], "left_semi", tasks).select(PAGE, "node", F.posexplode("path").alias("at", "root"))
    up = spread(up, tasks, PAGE, "root")
    held = up.groupBy(PAGE, "root").agg(F.count("*").alias("held"))
    fit = sorted_join(nodes, region_columns(regions), PAGE, tasks=tasks).where(plausible_root()).select(PAGE, F.col("node").alias("root"), "tag", "role", "w", "h")
    chain = sorted_join(sorted_join(up, spread(fit, tasks, PAGE, "root"), [PAGE, "root"]), held, [PAGE, "root"])
    semantic = (F.col("role") == "listitem") | F.col("tag").isin("li", "article")
    chain = spread(chain, tasks, PAGE).withColumn("near", F.max(F.when(semantic, F.struct("at", "root"))).over(Window.partitionBy(PAGE, "node")))
    found = chain.where("near is not null").select(PAGE, "node", F.col("near.root").alias("root")).distinct()
    alone = chain.where("near is null and held = 1")
    other = fit.select(PAGE, "tag", F.coalesce("role", F.lit("")).alias("kind"), F.col("root").alias("peer"), F.col("w").alias("pw"), F.col("h").alias("ph"))
    roots = alone.select(PAGE, "root", "tag", F.coalesce("role", F.lit("")).alias("kind"), "w", "h").distinct()
    peers = sorted_join(roots, other, [PAGE, "tag", "kind"], tasks=tasks).where(
        (F.col("peer") != F.col("root")) & (nearness(F.col("w"), F.col("pw")) >= NEAR_WIDTH) & (nearness(F.col("h"), F.col("ph")) >= NEAR_HEIGHT)
    )
    peers = spread(peers, tasks, PAGE, "root").groupBy(PAGE, "root").agg(F.count("*").alias("peers"))
    order = F.struct((-F.coalesce("peers", F.lit(0))).alias("p"), (-F.col("w") * F.col("h")).alias("a"), "root")
    best = spread(sorted_join(spread(alone, tasks, PAGE, "root"), peers, [PAGE, "root"], "left"), tasks, PAGE).groupBy(PAGE, "node").agg(F.min(order)["root"].alias("root"))
    return found.unionByName(best)


def markup_titles(markup: Column) -> Column:
    """Distinct image titles ``img_alt=...>`` of two words or more, in order."""
    found = F.transform(F.regexp_extract_all(markup, F.lit(r"\bimg_alt=([^>]+)>"), F.lit(1)), lambda x: F.trim(x))
    return F.array_distinct(F.filter(found, lambda x: F.contains(squeezed_alnum(x), F.lit(" "))))


def map_titles(nodes: DataFrame, markup: DataFrame, regions: DataFrame, tasks: int | None = None) -> DataFrame:
    """``(page_id, cards, titles, matched, unmatched, repeated)`` of each page of ``markup(page_id, markup)``.

    Each title takes the node whose text or label is most like it, from ``EVIDENCE`` on; ties prefer images, then labels, then the
    first node. Matched nodes give their cards; two titles of one card count as repeated. Titles meet the nodes of their
    own page only; both are squeezed and cut into words before they meet. ``tasks`` is that of ``sorted_join``.
    """
    asked = markup.select(PAGE, markup_titles(F.col("markup")).alias("titles"))
    titles = asked.select(PAGE, F.posexplode("titles").alias("at", "title")).select(PAGE, "at", squeezed_alnum(F.col("title")).alias("a")).withColumn("x", word_set(F.col("a")))
    words = nodes.select(PAGE, "node", "tag", F.col("label").isNotNull().alias("named"), F.explode(F.array_compact(F.array("text", "label"))).alias("words")).where(F.trim("words") != "")
    words = words.select(PAGE, "node", "tag", "named", squeezed_alnum(F.col("words")).alias("b")).where("b <> ''").withColumn("y", word_set(F.col("b")))
    liked = sorted_join(titles, words, PAGE, tasks=tasks).withColumn("score", squeezed_similarity(*map(F.col, "axby"))).where(F.col("score") >= EVIDENCE)
    image = F.col("tag") == "img"
    preference = F.when(image, 4).otherwise(0) + F.when(image & F.col("named"), 2).otherwise(0) + F.when(F.col("named"), 1).otherwise(0)
    best = liked.groupBy(PAGE, "at").agg(F.max(F.struct("score", preference.alias("p"), (-F.col("node")).alias("n"), "node"))["node"].alias("node"))
    roots = sorted_join(best, card_roots(nodes, best, regions, tasks), [PAGE, "node"], "left", tasks).groupBy(PAGE)
    roots = roots.agg(F.array_sort(F.collect_set("root")).alias("cards"), F.count("*").alias("matched"), F.count("root").alias("rooted"))
    out = sorted_join(asked.select(PAGE, F.size("titles").cast("long").alias("titles")), roots, PAGE, "left")
    matched, cards = F.coalesce("matched", F.lit(0)), F.coalesce("cards", F.array().cast("array<int>"))
    return out.select(
        PAGE, cards.alias("cards"), "titles", matched.alias("matched"), (F.col("titles") - matched).alias("unmatched"),
        (F.coalesce("rooted", F.lit(0)) - F.size(cards)).alias("repeated"),
    )


def discovery_regions(regions: DataFrame, height: float = 900.0) -> DataFrame:
    """Bands of ``height`` (320 at least) from the top of each region down: ``(page_id, view, x, y, w, h)``; the last may be lower."""
    height = max(320.0, height)
    bands = F.sequence(F.lit(0), (F.ceil(F.col("h") / height) - 1).cast("int"))
    rows = regions.where("h > 0").select("*", F.explode(bands).alias("view"))
    return rows.select(PAGE, "view", "x", (F.col("y") + F.col("view") * height).alias("y"), "w", F.least(F.lit(height), F.col("h") - F.col("view") * height).alias("h"))


def extraction_regions(nodes: DataFrame, cards: DataFrame, regions: DataFrame, padding: float = 24.0) -> DataFrame:
    """The box of each of ``cards(page_id, node)`` with a margin, inside its page's region: ``(page_id, view, x, y, w, h)``, view being the card."""
    rows = sorted_join(sorted_join(nodes, cards.select(PAGE, "node").distinct(), [PAGE, "node"], "left_semi"), region_columns(regions), PAGE)
    left, top = F.greatest(F.col("rx"), F.col("x") - padding), F.greatest(F.col("ry"), F.col("y") - padding)
    right, low = F.least(F.expr("rx + rw"), F.expr("x + w") + padding), F.least(F.expr("ry + rh"), F.expr("y + h") + padding)
    one = F.lit(1.0)
    return rows.select(PAGE, F.col("node").alias("view"), left.alias("x"), top.alias("y"), F.greatest(one, right - left).alias("w"), F.greatest(one, low - top).alias("h"))


def relative_crop(views: DataFrame, regions: DataFrame) -> DataFrame:
    """``(page_id, view, left, top, width, height)``: whole pixels of each view in its page's picture, rounded outwards."""
    rows = sorted_join(views, region_columns(regions), PAGE)
    left, top = (F.greatest(F.lit(0), F.floor(F.expr(e))) for e in ("x - rx", "y - ry"))
    right, low = F.ceil(F.expr("x - rx + w")), F.ceil(F.expr("y - ry + h"))
    one = F.lit(1)
    return rows.select(PAGE, "view", left.alias("left"), top.alias("top"), F.greatest(one, right - left).alias("width"), F.greatest(one, low - top).alias("height"))


#: What stands before the nodes in a prompt, and what a prompt's nodes are read as.
MARK = "OBSERVATION: "
PROMPT_NODE = "struct<id:int,parent:int,tag:string,role:string,text:string,name:string,bounds:struct<x:double,y:double,width:double,height:double>,interactive:boolean>"
PROMPT = f"struct<page:long,region:struct<x:double,y:double,width:double,height:double>,root:int,nodes:array<{PROMPT_NODE}>>"


def prompts(nodes: DataFrame, views: DataFrame, task: str, instruction: str) -> DataFrame:
    """``(page_id, view, prompt, nodes)``: the nodes of each view as one line of JSON below a task and its instruction.

    A view's nodes, which ``prune`` bounds, are gathered in document order. Absent values are left out.
    """
    box = F.struct("x", "y", F.col("w").alias("width"), F.col("h").alias("height"))
    parent = F.try_element_at("path", F.lit(-2))
    one = F.struct(
        F.col("node").alias("id"), parent.alias("parent"), "tag", "role", "text", F.col("label").alias("name"), box.alias("bounds"), F.when(F.col("interactive"), True).alias("interactive")
    )
    held = nodes.groupBy(PAGE, "view").agg(F.array_sort(F.collect_list(one), lambda a, b: a["id"] - b["id"]).alias("held"))
    rows = sorted_join(held, views.select(PAGE, "view", box.alias("region")), [PAGE, "view"])
    body = F.to_json(F.struct(F.col(PAGE).alias("page"), "region", F.col("held")[0]["id"].alias("root"), F.col("held").alias("nodes")))
    return rows.select(PAGE, "view", F.concat(F.lit(f"TASK: {task}\n{instruction}\n{MARK}"), body).alias("prompt"), F.size("held").alias("nodes"))


def parse_prompts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The node table that ``rows(keys, prompt)`` were made of, with paths; prompts without readable nodes give no rows.

    A node whose parent isn't in its prompt is a root.
    """
    at = F.instr("prompt", MARK)
    read = rows.where(at > 0).select(*keys, F.from_json(F.substring("prompt", at + len(MARK), F.length("prompt")), PROMPT).alias("o"))
    kind = "map<int,array<int>>"
    step = lambda known, n: F.map_concat(known, F.create_map(n["id"], F.concat(F.coalesce(known[n["parent"]], F.array().cast("array<int>")), F.array(n["id"]))))
    read = read.withColumn("paths", F.aggregate("o.nodes", F.create_map().cast(kind), step))
    rows = read.select(*keys, "paths", F.inline("o.nodes"))
    return rows.select(
        *keys, F.col("id").alias("node"), F.col("paths")[F.col("id")].alias("path"), "tag", "role", "text", F.col("name").alias("label"),
        F.coalesce("interactive", F.lit(False)).alias("interactive"), "bounds.x", "bounds.y", F.col("bounds.width").alias("w"), F.col("bounds.height").alias("h"),
    )

"""Joins and aggregates that compare labels, predictions, reviewers and targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import free_name


def rate(hits: Column, n: Column, empty: float | None = None) -> Column:
    """``hits / n``; ``empty`` where there is nothing to count."""
    return F.when(n > 0, hits / n).otherwise(F.lit(empty).cast("double"))


def cover(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``(key, status)`` of every key on either side: exact (once on each), missing (left only), unexpected (right only) or duplicate."""
    a = left.groupBy(key).agg(F.count("*").alias("a"))
    b = right.groupBy(key).agg(F.count("*").alias("b"))
    n = a.join(b, key, "full_outer").select(key, F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    status = F.when(F.col("b") == 0, "missing").when(F.col("a") == 0, "unexpected").when((F.col("a") > 1) | (F.col("b") > 1), "duplicate").otherwise("exact")
    return n.select(key, status.alias("status"))


def with_status(labels: DataFrame, predictions: DataFrame, key: str, value: str) -> DataFrame:
    """Every label with its prediction: ``status`` correct, incorrect or missing."""
    given = free_name(labels, "given")
    joined = labels.join(predictions.select(key, F.col(value).alias(given)), key, "left")
    status = F.when(F.col(given).isNull(), "missing").when(F.col(given) == F.col(value), "correct").otherwise("incorrect")
    return joined.withColumn("status", status).drop(given)


def compare_reviews(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``(key, field)`` of every disagreement of two reviews; a key on one side only disagrees in its ``root``."""
    both = a.select(key, F.lit(True).alias("in_a"), *(F.col(f).alias(f"a_{f}") for f in fields)).join(
        b.select(key, F.lit(True).alias("in_b"), *(F.col(f).alias(f"b_{f}") for f in fields)), key, "full_outer"
    )
    alone = F.col("in_a").isNull() | F.col("in_b").isNull()
    found = F.array(*(F.when(~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), f) for f in fields))
    return both.select(key, F.explode(F.array_compact(F.when(alone, F.array(F.lit("root"))).otherwise(found))).alias("field"))


def confusion(rows: DataFrame, by: list[str], a: Column, b: Column) -> DataFrame:
    """Counts of two yes-or-no ratings: ``both, a_only, b_only, neither``."""
    n = lambda c, name: F.count_if(c).alias(name)
    return rows.groupBy(*by).agg(n(a & b, "both"), n(a & ~b, "a_only"), n(~a & b, "b_only"), n(~a & ~b, "neither"))


def kappa(both: Column, a_only: Column, b_only: Column, neither: Column, undecided: float | None = 0.0, empty: float | None = None) -> Column:
    """Cohen's kappa from counts. Where chance alone explains all, 1 if all agree and else ``undecided``; ``empty`` without pairs."""
    n = both + a_only + b_only + neither
    observed, p, q = (both + neither) / n, (both + a_only) / n, (both + b_only) / n
    expected = p * q + (1 - p) * (1 - q)
    certain = F.when(observed == 1, F.lit(1.0)).otherwise(F.lit(undecided).cast("double"))
    return F.when(n == 0, F.lit(empty).cast("double")).when(expected == 1, certain).otherwise((observed - expected) / (1 - expected))


def weighted_rates(pages: DataFrame, by: list[str], weight: str, rates: list[str]) -> DataFrame:
    """Means of rates weighted by a count of cards; 0 without cards."""
    n = F.sum(weight)
    return pages.groupBy(*by).agg(n.alias(weight), *(F.coalesce(F.try_divide(F.sum(F.col(r) * F.col(weight)), n), F.lit(0.0)).alias(r) for r in rates))


def precision_recall(rows: DataFrame, by: list[str], predicted: Column, actual: Column) -> DataFrame:
    """Counts and precision, recall and F1; 0 where a denominator is 0."""
    n = lambda c, name: F.count_if(c).alias(name)
    out = rows.groupBy(*by).agg(n(predicted & actual, "tp"), n(predicted & ~actual, "fp"), n(~predicted & actual, "fn"))
    return with_scores(out)


def with_scores(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select("*", rate(tp, tp + fp, 0.0).alias("precision"), rate(tp, tp + fn, 0.0).alias("recall"), rate(2 * tp, 2 * tp + fp + fn, 0.0).alias("f1"))


def threshold_sweep(rows: DataFrame, score: Column, actual: Column, thresholds: list[float]) -> DataFrame:
    """``precision_recall`` of ``score >= threshold`` for every threshold in one pass.

    Rows are counted by how many thresholds they reach; sums over that small table give every threshold.
    """
    steps = sorted(thresholds)
    reached = sum((F.when(score >= t, 1).otherwise(0) for t in steps), F.lit(0))
    counts = rows.groupBy(reached.alias("reached")).agg(F.count_if(actual).alias("yes"), F.count_if(~actual).alias("no"))
    table = rows.sparkSession.createDataFrame(list(enumerate(steps, 1)), "step int, threshold double")
    hit = F.col("reached") >= F.col("step")
    # At most len(thresholds) + 1 counts meet len(thresholds) steps.
    pairs = counts.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(steps))))).join(F.broadcast(table), "step")
    out = pairs.groupBy("threshold").agg(
        F.sum(F.when(hit, F.col("yes")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("no")).otherwise(0)).alias("fp"), F.sum(F.when(~hit, F.col("yes")).otherwise(0)).alias("fn")
    )
    return with_scores(out)


def ranked_values(rows: DataFrame, by: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """``n``, ``least``, ``most``, ``mean`` and, by name, the value at place ``min(n - 1, floor(n q))`` of each group.

    Equal values are counted first; places are looked up in running sums over distinct values, so no group is gathered.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by).orderBy(value)
    whole = Window.partitionBy(*by)
    known = counts.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(whole))
    places = {name: F.least(F.col("n") - 1, F.floor(F.col("n") * q)) for name, q in quantiles.items()}
    picks = [F.min(F.when(F.col("upto") > place, F.col(value))).alias(name) for name, place in places.items()]
    total = F.sum(F.col(value) * F.col("c")) / F.sum("c")
    return known.groupBy(*by).agg(F.sum("c").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), total.alias("mean"), *picks)


def target_gaps(actual: DataFrame, targets: DataFrame, by: list[str]) -> DataFrame:
    """``(by, metric, actual, target)`` of metrics under their target, or over it where ``most`` says that it is a bound from above."""
    metrics = [c for c in actual.columns if c not in by]
    long = actual.unpivot(by, metrics, "metric", "actual")
    missed = F.when(F.col("most"), F.col("actual") > F.col("target")).otherwise(F.col("actual") < F.col("target"))
    return long.join(F.broadcast(targets), "metric").where(missed).select(*by, "metric", "actual", "target")


def concentration(rows: DataFrame, by: list[str], part: str) -> DataFrame:
    """``(by, parts, share)``: the share of the largest part of each group."""
    counts = rows.groupBy(*by, part).agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg(F.count("*").alias("parts"), (F.max("n") / F.sum("n")).alias("share"))


def precision_bound(n: Column, errors: Column) -> Column:
    """Lower bound (95 %) of the precision after ``n`` accepted cases: 0 unless there was no error."""
    return F.when((errors == 0) & (n > 0), F.pow(F.lit(0.05), 1 / n)).otherwise(0.0)


def sample_size(margin: Column, z: float = 1.96, design: float = 1.0) -> Column:
    """Cases that an error margin asks for in the worst case; null for a margin outside 0 to 1."""
    return F.when((margin > 0) & (margin < 1), F.ceil(z * z * 0.25 / (margin * margin) * design))


#: A page with more nodes than this is looked through by a grid.
CROWD = 256


def best_box(boxes: DataFrame, nodes: DataFrame, page: str, least: float = 0.15, near: float = 0.9, tasks: int | None = None) -> DataFrame:
    """For every box the node of its page that covers it best: ``boxes`` with ``node_id`` and ``iou``.

    Boxes and nodes have ``x, y, w, h``; nodes also ``node_id, depth, listed``. Of overlaps of ``near`` times the best a list
    item is preferred, then the shallower, the larger and the smaller id. On pages of ``CROWD`` nodes at most each box meets all of
    them, so rows are shuffled once, by page. On others a node lies in a grid whose cells are the power of two from its longer
    side on, so in four cells at most, however large others on its page are. An overlap of ``least`` bounds
    how much larger one of the two is, so a box looks only at cells of a few sizes, and at those that it meets. ``tasks`` is that of ``sorted_join``.
    """
    from .tree import sorted_join, spread

    level = lambda side: F.ceil(F.log2(F.greatest(side, F.lit(1.0)))).cast("int")

    def cells(d: DataFrame, size: Column) -> DataFrame:
        for a, s in (("x", "w"), ("y", "h")):
            d = d.withColumn(f"c{a}", F.explode(F.sequence(F.floor(F.col(a) / size), F.floor((F.col(a) + F.col(s)) / size))))
        return d

    real = "w >= 0 and h >= 0 and x is not null and y is not null"
    boxes, nodes = boxes.where(real), nodes.select(page, "node_id", "depth", "listed", "x", "y", "w", "h").where(real)
    boxes, nodes = spread(boxes, tasks, page), spread(nodes, tasks, page)
    crowded = nodes.groupBy(page).agg(F.count("*").alias("held")).where(F.col("held") > CROWD).select(page)
    told = [page, "node_id", "depth", "listed", *(F.col(c).alias(f"n{c}") for c in "xywh")]
    few = sorted_join(sorted_join(boxes, crowded, page, "left_anti"), nodes.select(*told), page)
    boxes_left, n = sorted_join(boxes, crowded, page, "left_semi"), sorted_join(nodes, crowded, page, "left_semi").withColumn("level", level(F.greatest("w", "h")))
    n = cells(n, F.pow(F.lit(2.0), F.col("level"))).select("level", "cx", "cy", *told)
    # Both sides of the overlap are at most the smaller side, so with overlap L each side is within 1/L of the other's.
    low, high = level(F.greatest("w", "h") * least), level(F.greatest("w", "h") / least)
    asked = boxes_left.withColumn("level", F.explode(F.sequence(low, high)))
    many = cells(asked, F.pow(F.lit(2.0), F.col("level"))).join(n, [page, "level", "cx", "cy"]).drop("level", "cx", "cy")
    over = lambda a, s: F.greatest(F.lit(0.0), F.least(F.col(a) + F.col(s), F.col(f"n{a}") + F.col(f"n{s}")) - F.greatest(F.col(a), F.col(f"n{a}")))
    both = over("x", "w") * over("y", "h")
    union = F.col("w") * F.col("h") + F.col("nw") * F.col("nh") - both
    w = Window.partitionBy(*boxes.columns)
    first = w.orderBy(F.desc("listed"), "depth", F.desc(F.col("nw") * F.col("nh")), "node_id")

    def best(pairs: DataFrame) -> DataFrame:
        pairs = pairs.withColumn("iou", F.coalesce(F.try_divide(both, union), F.lit(0.0))).where(F.col("iou") >= least)
        pairs = pairs.dropDuplicates([*boxes.columns, "node_id"])
        close = pairs.withColumn("best", F.max("iou").over(w)).where(F.col("iou") >= near * F.col("best"))
        return close.withColumn("r", F.row_number().over(first)).where("r = 1").select(*boxes.columns, "node_id", "iou")

    # Chosen apart, the pairs of either kind stay where their page lies.
    return best(few).unionByName(best(many))


def contained_labels(labels: DataFrame, texts: DataFrame, by: list[str]) -> DataFrame:
    """``(by, label, text, relation)``: for each of ``labels(by, label)`` the shortest of ``texts(by, text)`` that equals, holds or is held by it.

    Blanks are squeezed and case is ignored; ties go to the first text. Instead of comparing all of a group, what may be
    contained meets by its first three characters what has them anywhere (shorter ones by all they have), and is then
    looked for as a whole.
    """
    from .selection import first_n

    plain = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    left = labels.select(*by, "label", plain("label").alias("a")).where("a <> ''").distinct()
    right = texts.select(*by, "text", plain("text").alias("b")).where("b <> ''").distinct()

    def grams(c: str) -> Column:
        starts = lambda n: F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1)))
        each = lambda n: F.transform(starts(n), lambda i: F.substring(c, i, F.lit(n)))
        return F.array_distinct(F.concat(*map(each, (1, 2, 3))))

    def within(small: DataFrame, s: str, large: DataFrame, g: str) -> DataFrame:
        keyed = small.withColumn("gram", F.substring(s, 1, 3))
        return keyed.join(large.withColumn("gram", F.explode(grams(g))), [*by, "gram"]).where(F.contains(g, s)).drop("gram")

    both = within(left, "a", right, "b").unionByName(within(right, "b", left, "a")).distinct()
    relation = F.when(F.col("a") == F.col("b"), "equal").when(F.contains("b", F.col("a")), "contains").otherwise("contained")
    return first_n(both.withColumn("relation", relation), [*by, "label"], 1, F.length("text"), "text").select(*by, "label", "text", "relation")

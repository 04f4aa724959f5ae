"""Queries over joins, aggregates, samples and sets on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import compare, evaluation, selection, sets
from .common import SQL_MACROS, r4, registry, table, tasks_for

QUERIES, ORACLE_SQL, query = registry()
sql_r4 = SQL_MACROS["r4"]


def rounded(df, *names):
    return df.select(*(r4(F.col(c)).alias(c) if c in names else F.col(c) for c in df.columns))


SCORES = ", ".join(
    f"{sql_r4(f'CASE WHEN {d} > 0 THEN ({n})::DOUBLE / ({d}) ELSE 0 END')} AS {name}" for name, n, d in (("precision", "tp", "tp + fp"), ("recall", "tp", "tp + fn"), ("f1", "2 * tp", "2 * tp + fp + fn"))
)


@query(
    "record_cover",
    """WITH a AS (SELECT doc_id, count(*) AS a FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1),
    b AS (SELECT doc_id, count(*) AS b FROM (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM labels WHERE doc_id % 50 = 1) GROUP BY 1)
    SELECT doc_id, CASE WHEN b IS NULL THEN 'missing' WHEN a IS NULL THEN 'unexpected' WHEN a > 1 OR b > 1 THEN 'duplicate' ELSE 'exact' END AS status FROM a FULL JOIN b USING (doc_id)""",
)
def record_cover(spark, sf_dir):
    """every record is covered exactly once, or how it is not."""
    d, l = table(spark, sf_dir, "documents").where("doc_id % 3 <> 0"), table(spark, sf_dir, "labels").select("doc_id")
    return evaluation.cover(d, l.unionByName(l.where("doc_id % 50 = 1")), "doc_id")


@query(
    "label_status",
    """SELECT l.doc_id, CASE WHEN d.doc_id IS NULL THEN 'missing' WHEN (d.n_chars > 1500)::INT = l.quality THEN 'correct' ELSE 'incorrect' END AS status
    FROM labels l LEFT JOIN (SELECT * FROM documents WHERE doc_id % 4 <> 0) d USING (doc_id)""",
)
def label_status(spark, sf_dir):
    """labels with their predictions; what is not predicted is missing."""
    p = table(spark, sf_dir, "documents").where("doc_id % 4 <> 0").select("doc_id", (F.col("n_chars") > 1500).cast("int").alias("quality"))
    return evaluation.with_status(table(spark, sf_dir, "labels"), p, "doc_id", "quality").select("doc_id", "status")


@query(
    "false_and_missed",
    """SELECT doc_id, 'missed' AS kind FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE source LIKE '%1') UNION ALL
    SELECT doc_id, 'false' FROM documents WHERE source LIKE '%1' AND doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def false_and_missed(spark, sf_dir):
    """Predictions without a label and labels without a prediction."""
    l, d = table(spark, sf_dir, "labels").select("doc_id"), table(spark, sf_dir, "documents").where("source like '%1'").select("doc_id")
    return l.join(d, "doc_id", "left_anti").withColumn("kind", F.lit("missed")).unionByName(d.join(l, "doc_id", "left_anti").withColumn("kind", F.lit("false")))


@query(
    "review_disagreements",
    """WITH a AS (SELECT doc_id, lang, source, n_chars > 1000 AS long FROM documents WHERE doc_id % 7 <> 0),
    b AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'xx' ELSE lang END AS lang, source, n_chars > 1200 AS long FROM documents WHERE doc_id % 11 <> 0),
    j AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.doc_id IS NULL OR b.doc_id IS NULL AS alone, a.lang IS DISTINCT FROM b.lang AS l, a.long IS DISTINCT FROM b.long AS n
      FROM a FULL JOIN b ON a.doc_id = b.doc_id)
    SELECT doc_id, 'root' AS field FROM j WHERE alone UNION ALL SELECT doc_id, 'lang' FROM j WHERE NOT alone AND l UNION ALL SELECT doc_id, 'long' FROM j WHERE NOT alone AND n""",
)
def review_disagreements(spark, sf_dir):
    """Where two independent reviews differ, field by field."""
    d = table(spark, sf_dir, "documents")
    a = d.where("doc_id % 7 <> 0").select("doc_id", "lang", "source", (F.col("n_chars") > 1000).alias("long"))
    lang = F.when(F.col("doc_id") % 5 == 0, "xx").otherwise(F.col("lang"))
    b = d.where("doc_id % 11 <> 0").select("doc_id", lang.alias("lang"), "source", (F.col("n_chars") > 1200).alias("long"))
    return evaluation.compare_reviews(a, b, "doc_id", ["lang", "source", "long"])


@query(
    "latest_per_key",
    """SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events) WHERE r = 1""",
)
def latest_per_key(spark, sf_dir):
    """The newest event of every user; of equal times the first."""
    return compare.latest(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type")


@query(
    "registry_lookup",
    """SELECT p.page_id, CASE WHEN r.k IS NULL THEN 'unregistered' WHEN r.url <> p.url THEN 'identity-mismatch' ELSE 'registered' END AS status
    FROM pages p LEFT JOIN (SELECT sha256(html) AS k, CASE WHEN page_id % 10 = 3 THEN 'moved' ELSE url END AS url FROM pages WHERE page_id % 4 <> 0) r ON sha256(p.html) = r.k""",
)
def registry_lookup(spark, sf_dir):
    """captures found in a registry by the hash of what was observed, then checked for identity."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.sha2("html", 256).alias("k"))
    r = p.where("page_id % 4 <> 0").select("k", F.when(F.col("page_id") % 10 == 3, "moved").otherwise(F.col("url")).alias("known"))
    status = F.when(F.col("known").isNull(), "unregistered").when(F.col("known") != F.col("url"), "identity-mismatch").otherwise("registered")
    return p.join(r, "k", "left").select("page_id", status.alias("status"))


@query(
    "overlay_status",
    """WITH o AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN -1 ELSE quality END AS mark, quality FROM labels UNION ALL SELECT doc_id + 1000000000, 0, 0 FROM labels WHERE doc_id % 20 = 0)
    SELECT coalesce(d.doc_id, o.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'skipped' WHEN d.doc_id IS NULL THEN 'unused' WHEN o.mark <> o.quality THEN 'rejected' ELSE 'used' END AS status
    FROM documents d FULL JOIN o ON d.doc_id = o.doc_id""",
)
def overlay_status(spark, sf_dir):
    """F16: captures with an overlay of adjudications, and what either side has left over."""
    l = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("doc_id") % 9 == 0, -1).otherwise(F.col("quality")).alias("mark"), "quality")
    o = l.unionByName(l.where("doc_id % 20 = 0").select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), F.lit(0).alias("mark"), F.lit(0).alias("quality")))
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit(True).alias("captured"))
    status = F.when(F.col("mark").isNull(), "skipped").when(F.col("captured").isNull(), "unused").when(F.col("mark") != F.col("quality"), "rejected").otherwise("used")
    return d.join(o, "doc_id", "full_outer").select("doc_id", status.alias("status"))


@query(
    "lineage_sources",
    """SELECT hash, count(*) AS pages, array_to_string(list_sort(list(DISTINCT source)), ',') AS cohorts FROM (SELECT md5(text) AS hash, source FROM documents WHERE text IS NOT NULL) GROUP BY hash""",
)
def lineage_sources(spark, sf_dir):
    """which cohorts each text comes from (their number is small and fixed, so a set of them is)."""
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.md5(F.col("text")).alias("hash"), "source")
    cohorts = F.array_join(F.sort_array(F.collect_set("source")), ",")
    return d.groupBy("hash").agg(F.count("*").alias("pages"), cohorts.alias("cohorts"))


BOX = "SELECT l_orderkey AS page, l_linenumber AS n, (l_partkey % 40) * 10.0 AS x, (l_suppkey % 30) * 10.0 AS y, 80 + l_quantity AS w, 60 + l_quantity AS h, l_partkey, l_suppkey, l_extendedprice FROM lineitem WHERE l_orderkey % 5 = 0"


def boxes_of(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").where("l_orderkey % 5 = 0")
    place = ((F.col("l_partkey") % 40) * 10.0).alias("x"), ((F.col("l_suppkey") % 30) * 10.0).alias("y")
    return line.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("n"), *place, (80 + F.col("l_quantity")).alias("w"), (60 + F.col("l_quantity")).alias("h"), "l_partkey", "l_suppkey", "l_extendedprice")


#: Line items that one task groups, and boxes that one maps to nodes, on average at most.
TASK_LINES, TASK_BOXES = 500_000, 50_000


@query(
    "iou_join",
    f"""WITH b AS ({BOX}), n AS (SELECT page, concat(n, '-', l_partkey, '-', l_suppkey, '-', l_extendedprice) AS node_id, n % 3 AS depth, n % 2 = 0 AS listed, x + 15 AS x, y + 5 AS y, w, h FROM b),
    p AS (SELECT b.page, b.n, b.l_partkey, b.l_suppkey, b.l_extendedprice, b.x, b.y, b.w, b.h, n.node_id, n.depth, n.listed, n.w * n.h AS area,
      greatest(0, least(b.x + b.w, n.x + n.w) - greatest(b.x, n.x)) * greatest(0, least(b.y + b.h, n.y + n.h) - greatest(b.y, n.y)) AS inter, b.w * b.h + n.w * n.h AS total FROM b JOIN n ON b.page = n.page),
    i AS (SELECT DISTINCT *, inter / (total - inter) AS iou FROM p WHERE inter / (total - inter) >= 0.15),
    c AS (SELECT *, max(iou) OVER (PARTITION BY page, n, l_partkey, l_suppkey, l_extendedprice, x, y, w, h) AS best FROM i),
    r AS (SELECT *, row_number() OVER (PARTITION BY page, n, l_partkey, l_suppkey, l_extendedprice, x, y, w, h ORDER BY listed DESC, depth, area DESC, node_id) AS r FROM c WHERE iou >= 0.9 * best)
    SELECT page, n, l_partkey, node_id, {sql_r4("iou")} AS iou FROM r WHERE r = 1""",
)
def iou_join(spark, sf_dir):
    """Predicted boxes mapped to the node of their page that they cover best."""
    b = boxes_of(spark, sf_dir)
    node = F.concat_ws("-", "n", "l_partkey", "l_suppkey", "l_extendedprice")
    nodes = b.select("page", node.alias("node_id"), (F.col("n") % 3).alias("depth"), (F.col("n") % 2 == 0).alias("listed"), (F.col("x") + 15).alias("x"), (F.col("y") + 5).alias("y"), "w", "h")
    return rounded(evaluation.best_box(b, nodes, "page", tasks=tasks_for(b, TASK_BOXES)).select("page", "n", "l_partkey", "node_id", "iou"), "iou")


@query(
    "range_chunks",
    """WITH n AS (SELECT l_orderkey AS page, l_linenumber AS n, l_extendedprice / 20 + l_quantity / 2 AS cy FROM lineitem)
    SELECT page, CAST(floor(cy / 900) AS BIGINT) AS chunk, count(*) AS nodes, count(DISTINCT n) AS lines FROM n GROUP BY ALL""",
)
def range_chunks(spark, sf_dir):
    """Nodes fall into the one chunk of 900 units that holds their centre."""
    cy = F.col("l_extendedprice") / 20 + F.col("l_quantity") / 2
    line = table(spark, sf_dir, "lineitem")
    rows = line.select(F.col("l_orderkey").alias("page"), "l_linenumber", F.floor(cy / 900).alias("chunk"))
    # Dealt by page alone, all three counts are made where the rows lie, in tasks that hold the same however many rows there are.
    return rows.repartition(tasks_for(line, TASK_LINES), "page").groupBy("page", "chunk").agg(F.count("*").alias("nodes"), F.countDistinct("l_linenumber").alias("lines"))


@query(
    "region_overlap",
    f"""WITH b AS ({BOX}) SELECT page, count(*) AS inside, count_if(x >= 100 AND x + w <= 300) AS whole FROM b WHERE x < 300 AND x + w > 100 AND y < 200 AND y + h > 50 GROUP BY page""",
)
def region_overlap(spark, sf_dir):
    """Boxes that overlap a region strictly."""
    b = boxes_of(spark, sf_dir).where("x < 300 and x + w > 100 and y < 200 and y + h > 50")
    return b.groupBy("page").agg(F.count("*").alias("inside"), F.count_if(F.expr("x >= 100 and x + w <= 300")).alias("whole"))


@query(
    "audit_counters",
    """WITH f AS (SELECT l_shipdate, l_returnflag AS reason, l_linestatus AS dimension, CASE WHEN l_discount >= 0.09 THEN 'confirmed' WHEN l_tax >= 0.07 THEN 'semantic' WHEN l_quantity > 45 THEN 'review' ELSE 'none' END AS kind FROM lineitem)
    SELECT dimension, reason, count(*) AS n, count_if(kind = 'confirmed') AS confirmed, count_if(kind = 'semantic') AS semantic, count_if(kind = 'review') AS review
    FROM f GROUP BY GROUPING SETS ((dimension), (reason), ())""",
)
def audit_counters(spark, sf_dir):
    """Findings counted by their first kind, for dimensions, reasons and all in one pass."""
    kind = F.when(F.col("l_discount") >= 0.09, "confirmed").when(F.col("l_tax") >= 0.07, "semantic").when(F.col("l_quantity") > 45, "review").otherwise("none")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("reason"), F.col("l_linestatus").alias("dimension"), kind.alias("kind"))
    grouped = rows.groupingSets([["dimension"], ["reason"], []], "dimension", "reason")
    return grouped.agg(F.count("*").alias("n"), *(F.count_if(F.col("kind") == k).alias(k) for k in ("confirmed", "semantic", "review")))


@query(
    "merged_parts",
    """SELECT l_returnflag AS reason, count(*) AS n, count_if(l_quantity > 25) AS large FROM lineitem GROUP BY 1""",
)
def merged_parts(spark, sf_dir):
    """Counters of parts that were audited apart, added up."""
    line = table(spark, sf_dir, "lineitem").withColumn("part", F.floor(F.col("l_orderkey") / 100))
    parts = line.groupBy("part", F.col("l_returnflag").alias("reason")).agg(F.count("*").alias("n"), F.count_if(F.expr("l_quantity > 25")).alias("large"))
    return parts.groupBy("reason").agg(F.sum("n").alias("n"), F.sum("large").alias("large"))


@query(
    "review_summary",
    """WITH e AS (SELECT o_custkey, o_orderpriority AS decision, unnest([o_orderkey % 700, (o_orderkey + 1) % 700]) AS idx FROM orders),
    a AS (SELECT idx, count(*) AS n FROM e GROUP BY idx)
    SELECT decision, count(*) AS assignments, count(DISTINCT e.idx) AS outputs, count_if(n > 1) AS duplicated FROM e JOIN a USING (idx) GROUP BY decision""",
)
def review_summary(spark, sf_dir):
    """Assignments of grouped reviews, with those that are assigned twice."""
    k = F.col("o_orderkey")
    e = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("decision"), F.explode(F.array(k % 700, (k + 1) % 700)).alias("idx"))
    a = e.groupBy("idx").agg(F.count("*").alias("n"))
    return e.join(a, "idx").groupBy("decision").agg(F.count("*").alias("assignments"), F.countDistinct("idx").alias("outputs"), F.count_if(F.expr("n > 1")).alias("duplicated"))


@query(
    "pr_f1_scorecard",
    f"""WITH c AS (SELECT source, count_if(n_chars > 1200 AND quality = 1) AS tp, count_if(n_chars > 1200 AND quality <> 1) AS fp, count_if(n_chars <= 1200 AND quality = 1) AS fn
      FROM documents JOIN labels USING (doc_id) GROUP BY source) SELECT source, tp, fp, fn, {SCORES} FROM c""",
)
def pr_f1_scorecard(spark, sf_dir):
    """Precision, recall and F1 by source."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return rounded(evaluation.precision_recall(rows, ["source"], F.col("n_chars") > 1200, F.col("quality") == 1), "precision", "recall", "f1")


@query(
    "extraction_scorecard",
    f"""SELECT lang, source, count(*) AS records, {sql_r4("count_if(quality = 1)::DOUBLE / greatest(1, count(*))")} AS exact_rate,
      {sql_r4("count_if(quality = 1 AND toxic = 0)::DOUBLE / greatest(1, count_if(toxic = 0))")} AS coverage FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((), (lang), (source))""",
)
def extraction_scorecard(spark, sf_dir):
    """Rates for all, by slice and by site, with denominators of one at least."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").groupingSets([[], ["lang"], ["source"]], "lang", "source")
    hit, some = F.count_if(F.expr("quality = 1 and toxic = 0")), F.count_if(F.expr("toxic = 0"))
    return rows.agg(F.count("*").alias("records"), r4(F.count_if(F.expr("quality = 1")) / F.greatest(F.lit(1), F.count("*"))).alias("exact_rate"), r4(hit / F.greatest(F.lit(1), some)).alias("coverage"))


THRESHOLDS = [10.0, 25.0, 50.0, 75.0, 100.0]


@query(
    "threshold_sweep",
    f"""WITH t AS (SELECT unnest({THRESHOLDS}::DOUBLE[]) AS threshold), c AS (SELECT threshold, count_if(value >= threshold AND event_type = 'click') AS tp, count_if(value >= threshold AND event_type <> 'click') AS fp,
      count_if(NOT value >= threshold AND event_type = 'click') AS fn FROM events, t WHERE value IS NOT NULL GROUP BY threshold) SELECT threshold, tp, fp, fn, {SCORES} FROM c""",
)
def threshold_sweep(spark, sf_dir):
    """Scores at every threshold in one pass over the rows."""
    e = table(spark, sf_dir, "events").where("value is not null")
    return rounded(evaluation.threshold_sweep(e, F.col("value"), F.col("event_type") == "click", THRESHOLDS), "precision", "recall", "f1")


@query(
    "kappa",
    f"""WITH c AS (SELECT source, count_if(quality = 1 AND toxic = 0) AS a, count_if(quality = 1 AND toxic <> 0) AS b, count_if(quality <> 1 AND toxic = 0) AS c, count_if(quality <> 1 AND toxic <> 0) AS d
      FROM documents JOIN labels USING (doc_id) GROUP BY source), n AS (SELECT *, (a + b + c + d)::DOUBLE AS n FROM c),
    p AS (SELECT *, (a + d) / n AS o, ((a + b) / n) * ((a + c) / n) + (1 - (a + b) / n) * (1 - (a + c) / n) AS e FROM n)
    SELECT source, a AS "both", b AS a_only, c AS b_only, d AS neither, {sql_r4("CASE WHEN e = 1 THEN CASE WHEN o = 1 THEN 1.0 ELSE 0.0 END ELSE (o - e) / (1 - e) END")} AS kappa FROM p""",
)
def kappa(spark, sf_dir):
    """Agreement of two raters beyond chance, by source."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    c = evaluation.confusion(rows, ["source"], F.col("quality") == 1, F.col("toxic") == 0)
    return c.select("*", r4(evaluation.kappa(*map(F.col, ("both", "a_only", "b_only", "neither")))).alias("kappa"))


@query(
    "weighted_agreement",
    f"""WITH p AS (SELECT lang, source, count(*) AS cards, avg((quality = 1)::INT) AS exact_status, avg((toxic = 0)::INT) AS exact_price FROM documents JOIN labels USING (doc_id) GROUP BY ALL),
    a AS (SELECT lang, sum(cards)::BIGINT AS cards, sum(exact_status * cards) / sum(cards) AS s, sum(exact_price * cards) / sum(cards) AS p FROM p GROUP BY lang)
    SELECT lang, cards, {sql_r4("s + 1e-9")} AS exact_status, {sql_r4("p + 1e-9")} AS exact_price, s >= 0.5 AND p >= 0.5 AS passed FROM a""",
)
def weighted_agreement(spark, sf_dir):
    """Agreement of pages weighted by their cards, and the gate over it."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    pages = rows.groupBy("lang", "source").agg(F.count("*").alias("cards"), F.avg((F.col("quality") == 1).cast("int")).alias("exact_status"), F.avg((F.col("toxic") == 0).cast("int")).alias("exact_price"))
    out = evaluation.weighted_rates(pages, ["lang"], "cards", ["exact_status", "exact_price"]).withColumn("passed", F.expr("exact_status >= 0.5 and exact_price >= 0.5"))
    return out.select("lang", "cards", r4(F.col("exact_status") + 1e-9).alias("exact_status"), r4(F.col("exact_price") + 1e-9).alias("exact_price"), "passed")


@query(
    "cohort_counts",
    """SELECT lang, count(*) AS documents, count(DISTINCT source) AS sources, count(DISTINCT n_chars) AS lengths, count_if(n_chars > 2000) AS long FROM documents GROUP BY lang""",
)
def cohort_counts(spark, sf_dir):
    """Distinct and conditional counts of each cohort."""
    d = table(spark, sf_dir, "documents").groupBy("lang")
    return d.agg(F.count("*").alias("documents"), F.countDistinct("source").alias("sources"), F.countDistinct("n_chars").alias("lengths"), F.count_if(F.expr("n_chars > 2000")).alias("long"))


TARGETS = (("documents", 200.0, False), ("sources", 5.0, False), ("long", 3.0, True), ("share", 0.25, True))


@query(
    "target_gaps",
    f"""WITH s AS (SELECT lang, source, count(*) AS n, count_if(n_chars > 2000) AS long FROM documents GROUP BY ALL),
    a AS (SELECT lang, sum(n)::DOUBLE AS documents, count(*)::DOUBLE AS sources, sum(long)::DOUBLE AS long, max(n)::DOUBLE / sum(n) AS share FROM s GROUP BY lang),
    u AS (UNPIVOT a ON documents, sources, long, share INTO NAME metric VALUE actual), t(metric, target, most) AS (VALUES {", ".join(f"('{m}', {t}::DOUBLE, {b})" for m, t, b in TARGETS)})
    SELECT lang, metric, {sql_r4("actual")} AS actual, target FROM u JOIN t USING (metric) WHERE CASE WHEN most THEN actual > target ELSE actual < target END""",
)
def target_gaps(spark, sf_dir):
    """Metrics of each cohort that miss their target."""
    d = table(spark, sf_dir, "documents")
    share = evaluation.concentration(d, ["lang"], "source").select("lang", F.col("parts").cast("double").alias("sources"), "share")
    counts = d.groupBy("lang").agg(F.count("*").cast("double").alias("documents"), F.count_if(F.expr("n_chars > 2000")).cast("double").alias("long"))
    targets = spark.createDataFrame(list(TARGETS), "metric string, target double, most boolean")
    return rounded(evaluation.target_gaps(counts.join(share, "lang"), targets, ["lang"]), "actual")


@query(
    "temporal_domains",
    """SELECT o_orderpriority AS stratum, count(*) AS domains FROM (SELECT o_orderpriority, o_custkey FROM orders GROUP BY ALL HAVING count(DISTINCT CAST(o_orderdate AS DATE)) >= 3) GROUP BY 1""",
)
def temporal_domains(spark, sf_dir):
    """How many domains were captured on three dates or more."""
    o = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_custkey").agg(F.countDistinct(F.to_date("o_orderdate")).alias("dates")).where("dates >= 3")
    return o.groupBy(F.col("o_orderpriority").alias("stratum")).agg(F.count("*").alias("domains"))


@query(
    "percentile_summary",
    f"""WITH s AS (SELECT source, list_sort(list(n_chars)) AS v, count(*) AS n, avg(n_chars) AS mean FROM documents WHERE n_chars IS NOT NULL GROUP BY source)
    SELECT source, n, v[1] AS least, v[n] AS most, {sql_r4("mean")} AS mean, v[CAST(least(n - 1, floor(n * 0.5)) AS BIGINT) + 1] AS p50, v[CAST(least(n - 1, floor(n * 0.95)) AS BIGINT) + 1] AS p95 FROM s""",
)
def percentile_summary(spark, sf_dir):
    """Exact values at places of the order, from counts of distinct values."""
    return rounded(evaluation.ranked_values(table(spark, sf_dir, "documents"), ["source"], "n_chars", {"p50": 0.5, "p95": 0.95}), "mean")


@query(
    "ledger_spend",
    """WITH d AS (SELECT o_orderpriority AS phase, date_trunc('month', o_orderdate) AS month, count(*) AS runs, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY ALL)
    SELECT phase, strftime(month, '%Y-%m') AS month, runs, cents, CAST(sum(cents) OVER (PARTITION BY phase ORDER BY month) AS BIGINT) AS spent, sum(cents) OVER (PARTITION BY phase ORDER BY month) > 10000000000 AS over_cap FROM d""",
)
def ledger_spend(spark, sf_dir):
    """Runs and spend by phase, running totals against a cap."""
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("long"))
    m = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("phase"), F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("runs"), cents.alias("cents"))
    spent = F.sum("cents").over(Window.partitionBy("phase").orderBy("month"))
    return m.withColumn("spent", spent).withColumn("over_cap", F.col("spent") > 10_000_000_000)


@query(
    "precision_bounds",
    f"""WITH c AS (SELECT source, count(*) AS n, count_if(toxic = 1) AS errors FROM documents JOIN labels USING (doc_id) WHERE doc_id % 13 < 3 GROUP BY source)
    SELECT source, n, errors, {sql_r4("CASE WHEN errors = 0 THEN pow(0.05, 1.0 / n) ELSE 0 END")} AS bound, CAST(ceil(1.96::DOUBLE * 1.96::DOUBLE * 0.25::DOUBLE / ((n / 1000::DOUBLE) * (n / 1000::DOUBLE))) AS BIGINT) AS wanted FROM c WHERE n < 1000""",
)
def precision_bounds(spark, sf_dir):
    """What no errors prove, and how many cases a margin asks for."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").where("doc_id % 13 < 3")
    c = rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.expr("toxic = 1")).alias("errors")).where("n < 1000")
    return c.select("source", "n", "errors", r4(evaluation.precision_bound(F.col("n"), F.col("errors"))).alias("bound"), evaluation.sample_size(F.col("n") / 1000).alias("wanted"))


@query(
    "outcome_crosstab",
    """SELECT source, lang, count(*) AS n, count_if(n_chars > 1000) AS eligible FROM documents GROUP BY CUBE (source, lang)""",
)
def outcome_crosstab(spark, sf_dir):
    """Counts by site, by method and by both."""
    return table(spark, sf_dir, "documents").cube("source", "lang").agg(F.count("*").alias("n"), F.count_if(F.expr("n_chars > 1000")).alias("eligible"))


@query(
    "stable_rank_split",
    """WITH s AS (SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS k FROM customer), r AS (SELECT k, ('0x' || substr(sha256('20260724:' || k), 1, 8))::BIGINT AS h FROM s),
    v AS (SELECT k FROM (SELECT k, row_number() OVER (ORDER BY h, k) AS r, count(*) OVER () AS n FROM r) WHERE r <= greatest(1, floor(n * 0.25 + 0.5)))
    SELECT c_custkey, CASE WHEN v.k IS NULL THEN 'train' ELSE 'validation' END AS split FROM customer LEFT JOIN v ON CAST(c_nationkey AS VARCHAR) = v.k""",
)
def stable_rank_split(spark, sf_dir):
    """H7: a quarter of the sites, by a hash no run changes, is for validation."""
    return selection.site_split(table(spark, sf_dir, "customer"), "c_nationkey").select("c_custkey", "split")


HASHED = "md5(concat('7:', {}))"


@query(
    "balanced_sample",
    f"""SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {HASHED.format("o_orderkey")}, o_orderkey) AS r FROM orders) WHERE r <= 40""",
)
def balanced_sample(spark, sf_dir):
    """H8, H9: forty targets of every site in a seeded shuffle (the limit is the feature)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return selection.first_n(o, ["o_orderpriority"], 40, F.md5(F.concat(F.lit("7:"), F.col("o_orderkey").cast("string"))), "o_orderkey")


@query(
    "viewport_share",
    f"""SELECT page_id, CASE WHEN row_number() OVER (ORDER BY {HASHED.format("page_id")}, page_id) <= ceil(count(*) OVER () * 0.3) THEN 'narrow' ELSE 'desktop' END AS viewport FROM pages""",
)
def viewport_share(spark, sf_dir):
    """The first ceil of a share of a shuffle gets the narrow viewport."""
    p = table(spark, sf_dir, "pages").select("page_id", F.md5(F.concat(F.lit("7:"), F.col("page_id").cast("string"))).alias("h"))
    n = p.count()
    cut = p.orderBy("h", "page_id").limit(-(-n * 3 // 10)).select("page_id", F.lit("narrow").alias("viewport"))
    return p.select("page_id").join(cut, "page_id", "left").select("page_id", F.coalesce("viewport", F.lit("desktop")).alias("viewport"))


@query(
    "stratified_limit",
    """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents), t AS (SELECT doc_id, lang, row_number() OVER (ORDER BY r, lang) AS turn FROM r)
    SELECT doc_id, lang, CAST(turn AS INTEGER) AS turn FROM t WHERE turn <= 100""",
)
def stratified_limit(spark, sf_dir):
    """Languages take turns up to a hundred documents (the limit is the feature)."""
    return selection.round_robin(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", 100, "doc_id")


@query(
    "mixture",
    """WITH k AS (SELECT doc_id, quality = 1 AS own, row_number() OVER (PARTITION BY quality = 1 ORDER BY doc_id) - 1 AS r FROM labels), z AS (SELECT own, count(*) AS size FROM k WHERE r < 1000 GROUP BY own),
    p AS (SELECT i AS position, round_even(i * 0.3, 0) > round_even((i - 1) * 0.3, 0) AS own, round_even(i * 0.3, 0)::BIGINT AS u FROM range(1, 1001) t(i)),
    s AS (SELECT position, p.own, CASE WHEN p.own THEN u - 1 ELSE position - u - 1 END % size AS r FROM p JOIN z ON p.own = z.own)
    SELECT position, doc_id FROM s JOIN k ON s.own = k.own AND s.r = k.r""",
)
def mixture(spark, sf_dir):
    """A thousand positions, three tenths from one stratum, short sides repeated."""
    return selection.mixture(table(spark, sf_dir, "labels").select("doc_id", "quality"), "quality", 1, 1000, 0.3, "doc_id").select("position", "doc_id")


@query("batching", "SELECT page_id, CAST(floor((row_number() OVER (ORDER BY page_id) - 1) / 7) + 1 AS BIGINT) AS batch FROM (SELECT DISTINCT page_id FROM pages WHERE page_id IS NOT NULL)")
def batching(spark, sf_dir):
    """Pages in order, seven a batch."""
    return selection.batches(table(spark, sf_dir, "pages"), "page_id", 7)


@query(
    "top_candidates",
    """SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 20""",
)
def top_candidates(spark, sf_dir):
    """The best twenty of each page (the limit is the feature)."""
    return selection.first_n(table(spark, sf_dir, "documents"), ["source"], 20, F.desc("n_chars"), "doc_id").select("source", "doc_id")


@query(
    "group_ranking",
    """WITH g AS (SELECT o_custkey, o_orderpriority AS g, count(*) AS cards, count(*) * 2 + CASE WHEN o_orderpriority LIKE '1%' THEN 10 WHEN o_orderpriority LIKE '5%' THEN -8 ELSE 0 END AS score FROM orders GROUP BY o_custkey, o_orderpriority HAVING count(*) >= 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, cards DESC, g) AS r FROM g)
    SELECT o_custkey, g AS container, cards, score, CASE WHEN r = 1 THEN 'primary-results' ELSE 'secondary' END AS role FROM r""",
)
def group_ranking(spark, sf_dir):
    """Repeated groups of three cards or more, ranked; the first is primary."""
    g = table(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("container")).agg(F.count("*").alias("cards")).where("cards >= 3")
    bonus = F.when(F.col("container").startswith("1"), 10).when(F.col("container").startswith("5"), -8).otherwise(0)
    g = g.withColumn("score", F.col("cards") * 2 + bonus)
    w = Window.partitionBy("o_custkey").orderBy(F.desc("score"), F.desc("cards"), "container")
    return g.withColumn("role", F.when(F.row_number().over(w) == 1, "primary-results").otherwise("secondary"))


@query(
    "unambiguous_price",
    """WITH r AS (SELECT l_orderkey, l_extendedprice AS score, l_partkey, l_linenumber, l_suppkey, lead(l_extendedprice) OVER w AS after, row_number() OVER w AS r FROM lineitem
      WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_linenumber, l_suppkey))
    SELECT l_orderkey, score, l_partkey FROM r WHERE r = 1 AND (after IS NULL OR score - after >= 8000)""",
)
def unambiguous_price(spark, sf_dir):
    """The best price of a card if it is alone or leads by enough."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_extendedprice").alias("score"), "l_partkey", "l_linenumber", "l_suppkey")
    return selection.leading(rows, ["l_orderkey"], "score", 8000, "l_partkey", "l_linenumber", "l_suppkey").select("l_orderkey", "score", "l_partkey")


@query(
    "retry_candidates",
    """WITH l AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders)
    SELECT o_custkey, o_orderkey, o_orderstatus FROM l WHERE r = 1 AND o_orderstatus <> 'O' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')""",
)
def retry_candidates(spark, sf_dir):
    """The last result of each site, without those promoted before."""
    o = table(spark, sf_dir, "orders")
    last = compare.first_by(o, ["o_custkey"], F.desc("o_orderkey")).where("o_orderstatus <> 'O'")
    return last.join(o.where("o_orderpriority like '1%'").select("o_custkey"), "o_custkey", "left_anti").select("o_custkey", "o_orderkey", "o_orderstatus")


@query(
    "canonical_hrefs",
    """SELECT href, page_id FROM (SELECT regexp_extract(url, '^([a-zA-Z]+://[^/?#]+[^?#]*)', 1) AS href, page_id, row_number() OVER (PARTITION BY regexp_extract(url, '^([a-zA-Z]+://[^/?#]+[^?#]*)', 1) ORDER BY page_id) AS r FROM pages) WHERE r = 1""",
)
def canonical_hrefs(spark, sf_dir):
    """The first page of every origin and path."""
    from ..functions.text import sanitize_url

    p = table(spark, sf_dir, "pages").select(sanitize_url(F.col("url")).alias("href"), "page_id")
    return compare.first_by(p, ["href"], "page_id")


@query(
    "merged_queues",
    """WITH q AS (SELECT doc_id FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id FROM documents WHERE doc_id % 3 = 0) SELECT doc_id, count(*) AS n FROM q GROUP BY doc_id HAVING count(*) > 1""",
)
def merged_queues(spark, sf_dir):
    """Pages that stand in two queues of one reviewer."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    return sets.merge_queues([d.where("doc_id % 2 = 0"), d.where("doc_id % 3 = 0")], "doc_id")[1]


@query(
    "aligned_cards",
    "SELECT doc_id FROM documents WHERE n_chars > 800 INTERSECT SELECT doc_id FROM labels WHERE quality = 1",
)
def aligned_cards(spark, sf_dir):
    """Cards that both reviewers have."""
    return table(spark, sf_dir, "documents").where("n_chars > 800").select("doc_id").intersect(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"))


@query(
    "split_disjoint",
    """WITH s AS (SELECT c_nationkey % 12 AS site, CASE WHEN c_custkey % 50 = 0 THEN 'heldOut' WHEN c_nationkey % 12 < 5 THEN 'development' ELSE 'selection' END AS split FROM customer WHERE c_nationkey % 12 <> 7),
    g AS (SELECT site, count(DISTINCT split) AS n FROM s GROUP BY site), k AS (SELECT DISTINCT s_nationkey % 10 AS site FROM supplier)
    SELECT coalesce(g.site, k.site) AS site, CASE WHEN n IS NULL THEN 'unassigned' WHEN k.site IS NULL THEN 'unknown' ELSE 'overlap' END AS issue FROM g FULL JOIN k ON g.site = k.site
    WHERE n IS NULL OR k.site IS NULL OR n > 1""",
)
def split_disjoint(spark, sf_dir):
    """Sites in two splits, without a split, or unknown."""
    site = (F.col("c_nationkey") % 12).alias("site")
    split = F.when(F.col("c_custkey") % 50 == 0, "heldOut").when(F.col("c_nationkey") % 12 < 5, "development").otherwise("selection")
    s = table(spark, sf_dir, "customer").where("c_nationkey % 12 <> 7").select(site, split.alias("split"))
    k = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 10).alias("site"))
    return sets.split_violations(s, k, "site", "split")


SPLITS = {"development": [0, 1, 2, 3, 4], "selection": [5, 6, 7, 4], "heldOut": [8, 9]}


@query(
    "split_resolution",
    "SELECT c_custkey, CASE WHEN c_nationkey IN (0, 1, 2, 3, 4) THEN 'development' WHEN c_nationkey IN (5, 6, 7, 4) THEN 'selection' WHEN c_nationkey IN (8, 9) THEN 'heldOut' END AS split FROM customer",
)
def split_resolution(spark, sf_dir):
    """The first split that lists a site."""
    return table(spark, sf_dir, "customer").select("c_custkey", sets.split_of(F.col("c_nationkey"), SPLITS).alias("split"))


@query(
    "capture_retirement",
    """SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'retired' ELSE 'active' END AS state FROM pages WHERE page_id % 9 <> 0 UNION ALL SELECT page_id, 'retired' FROM pages WHERE page_id % 9 = 0""",
)
def capture_retirement(spark, sf_dir):
    """Replaced captures move from the active to the retired registry."""
    p = table(spark, sf_dir, "pages").select("page_id", F.md5("html").alias("hash"))
    active, retired = sets.retire(p.where("page_id % 9 <> 0"), p.where("page_id % 9 = 0"), p.where("page_id % 6 = 0"), ["page_id", "hash"])
    return active.select("page_id", F.lit("active").alias("state")).unionByName(retired.select("page_id", F.lit("retired").alias("state")))


@query(
    "duplicate_artefacts",
    """SELECT hash, count(*) AS n, CASE WHEN count(DISTINCT source) > 1 THEN 'conflict' ELSE 'duplicate' END AS issue FROM (SELECT md5(text) AS hash, source FROM documents WHERE text IS NOT NULL) GROUP BY hash HAVING count(*) > 1""",
)
def duplicate_artefacts(spark, sf_dir):
    """Artefacts of one identity, duplicate or in conflict."""
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.md5("text").alias("hash"), "source")
    return sets.artefact_conflicts(d, ["hash"], "source")

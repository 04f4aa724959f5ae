"""Merkle manifest of a dataset: a tree of hashes per group of rows, over them a tree of groups, and proofs for all rows.

Every node carries the interval of leaf ranks it covers. Building goes level by level: runs of ``fan`` neighbours become
their parent, whose interval spans theirs. Proofs go down again: nodes are bucketed by level and by the rank of their
parent, a join on bucket and containment of intervals attaches each node to its parent, and the parent's other intervals
are the node's siblings, left and right of it. A bucket has ``fan`` rows at most, so a group that holds a third of all
rows is spread like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, materialise, table

FAN = 16
PATH = "array<struct<left:string,right:string>>"


def field(c: Column) -> Column:
    """A value as ``bytes:value`` in its text form, ``-`` for null; no two rows of fields run together to the same text."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field, fields)), 256)


def ranked(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``rank`` (from 0, by ``order``) and ``n`` of their group; ``group`` is not null.

    Rows are sorted in ranges, and the counts of a group in each range are summed up, so no task holds a group.
    """
    cut = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    cut = materialise(cut.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "merkle-order")
    counts = cut.groupBy(group, "part").agg(F.count("*").alias("here"), F.min("at").alias("least"))
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("here").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(group, "part", (before - F.col("least")).alias("shift"), F.sum("here").over(whole).alias("n"))
    return cut.join(counts, [group, "part"]).withColumn("rank", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def ascend(leaves: DataFrame, fan: int = FAN) -> tuple[list[DataFrame], DataFrame]:
    """``(levels, tops)`` of ``leaves(g, rank, n, digest, load)``.

    A level has one row per run of nodes below: ``(g, rank, n, lo, hi, digest, children)``, the interval of leaf ranks being
    ``lo`` to ``hi`` (exclusive) and ``children`` ordered ``(lo, hi, digest, load)``. ``tops`` is ``(g, digest)``, the node that
    remains of each group. Each level is written, as the next one and the way down both read it.
    """
    most = leaves.agg(F.max("n")).first()[0] or 0
    nodes = leaves.select("g", "rank", "n", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "digest", "load")
    tops = nodes.where("n = 1").select("g", "digest")
    levels = []
    while most > 1:
        child = F.struct("lo", "hi", "digest", "load")
        runs = nodes.where("n > 1").groupBy("g", F.expr(f"rank div {fan}").alias("rank"))
        runs = runs.agg(F.first("n").alias("n"), F.array_sort(F.collect_list(child)).alias("children"))
        runs = runs.select(
            "g",
            "rank",
            F.expr(f"(n + {fan - 1}) div {fan}").alias("n"),
            F.col("children")[0]["lo"].alias("lo"),
            F.element_at("children", -1)["hi"].alias("hi"),
            F.sha2(F.array_join(F.col("children")["digest"], ""), 256).alias("digest"),
            "children",
        )
        levels.append(materialise(runs, "merkle-level"))
        nodes = levels[-1].drop("children").withColumn("load", F.lit(None).cast(leaves.schema["load"].dataType))
        tops = tops.unionByName(nodes.where("n = 1").select("g", "digest"))
        most = -(-most // fan)
    return levels, tops


def siblings(children: str, lo: str, hi: str) -> Column:
    """The parent's interval less the node's own: digests of the children left of it and right of it."""
    side = {k: F.expr(f"array_join(transform(filter({children}, c -> {test}), c -> c.digest), '')") for k, test in (("left", f"c.hi <= {lo}"), ("right", f"c.lo >= {hi}"))}
    return F.struct(*(v.alias(k) for k, v in side.items()))


def descend(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame, fan: int = FAN) -> DataFrame:
    """Rows ``(g, digest, load, top, path)``, one per leaf; ``tops(g, top, path)`` says what a group's top continues with.

    ``path`` has the siblings of each level, from the leaf up.
    """
    alone = leaves.where("n = 1").select("g", "digest", "load").join(tops, "g")
    above = None
    for runs in reversed(levels):
        here = runs.where("n = 1").join(tops, "g")
        if above is not None:
            up = above.select("g", F.col("rank").alias("bucket"), F.col("lo").alias("from"), F.col("hi").alias("to"), F.col("children").alias("run"), "top", "path")
            low = runs.where("n > 1").withColumn("bucket", F.expr(f"rank div {fan}")).join(up, ["g", "bucket"])
            low = low.where("from <= lo and hi <= to").withColumn("path", F.concat(F.array(siblings("run", "lo", "hi")), "path"))
            here = here.unionByName(low.select(*here.columns))
        above = here
    if above is None:
        return alone
    run = above.select("g", "children", "top", "path", F.explode("children").alias("leaf")).select("*", F.col("leaf.lo").alias("lo"), F.col("leaf.hi").alias("hi"))
    path = F.concat(F.array(siblings("children", "lo", "hi")), "path")
    return alone.unionByName(run.select("g", "leaf.digest", "leaf.load", "top", path.alias("path")))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda up, x: F.sha2(F.concat(x["left"], up, x["right"]), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def manifest(docs: DataFrame, fields: Sequence[str], load: Column, group: str = "source", key: str = "doc_id", fan: int = FAN) -> DataFrame:
    """One row per row of ``docs``: ``(key, group, leaf, load, subroot, root, path)``.

    ``leaf`` hashes ``fields``; ``load`` is any text column expression that goes along with a row. Leaves of a group ascend by
    ``key`` (null first; rows of one key by leaf), groups by their UTF-8 bytes (null first). Every run of ``fan`` nodes becomes
    a node until one remains. Repeated rows are leaves of their own; an empty table has no leaf, no root and gives no
    rows; null fields hash as ``-`` and unlike empty ones; further columns are ignored. Texts are hashed whole where
    they are read and never shuffled.
    """
    at = F.coalesce(F.concat(F.lit("1"), F.col(f"`{group}`").cast("string")), F.lit("0"))
    rows = docs.select(
        F.col(f"`{key}`").alias("id"),
        at.alias("g"),
        digest([F.col(f"`{f}`") for f in fields]).alias("digest"),
        load.cast("string").alias("load"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = ranked(materialise(rows, "merkle-leaves"), "g", ["id", "digest", "row"])
    leaves = materialise(rows.select("g", "rank", "n", "digest", F.struct("id", "load").alias("load")), "merkle-ranked")
    levels, tops = ascend(leaves, fan)
    tops = materialise(tops, "merkle-subroots")
    over = ranked(tops.select(F.lit("").alias("all"), F.col("g").alias("id"), "digest"), "all", ["id"])
    over = materialise(over.select(F.col("all").alias("g"), "rank", "n", "digest", F.col("id").alias("load")), "merkle-groups")
    high, root = ascend(over, fan)
    root = root.select("g", F.col("digest").alias("top"), F.array().cast(PATH).alias("path"))
    groups = descend(over, high, root, fan).select(F.col("load").alias("g"), F.struct("digest", "top").alias("top"), "path")
    found = descend(leaves, levels, materialise(groups, "merkle-group-paths"), fan)
    return found.select(
        F.col("load.id").alias(key),
        F.when(F.col("g") != "0", F.expr("substring(g, 2)")).alias(group),
        F.col("digest").alias("leaf"),
        F.col("load.load").alias("load"),
        F.col("top.digest").alias("subroot"),
        F.col("top.top").alias("root"),
        "path",
    )


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of every document, and the root that a tampered copy of it would give."""
    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    tampered = digest([ascii_lower(F.col(f)) if f == "text" else F.col(f) for f in fields])
    found = manifest(docs, fields, F.when(struck, tampered))
    folded = fold(F.coalesce("load", "leaf"), F.col("path"))
    found = found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))

"""Samples, splits, mixtures, batches and best picks, each a pure function of keys so that every run agrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import free_name


def stable_rank(site: Column, seed: int = 20260724) -> Column:
    """A site's place in a shuffle that no run changes: 32 bits of a hash."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), site), 256), 1, 8), 16, 10).cast("long")


def site_split(rows: DataFrame, site: str, share: float = 0.25, name: str = "split") -> DataFrame:
    """``rows`` with ``name`` validation for the first ``share`` of sites by ``stable_rank`` (one at least), else train.

    Sites are counted and ranked as a small table of their own.
    """
    sites = rows.select(F.col(site).cast("string").alias("key")).where("key is not null").distinct()
    w = Window.orderBy(stable_rank(F.col("key")), "key")
    n = F.count("*").over(Window.partitionBy())
    ranked = sites.withColumn("r", F.row_number().over(w)).withColumn("n", n)
    chosen = ranked.where(F.col("r") <= F.greatest(F.lit(1), F.floor(F.col("n") * share + 0.5))).select("key", F.lit("validation").alias(name))
    return rows.join(chosen, rows[site].cast("string") == chosen["key"], "left").drop("key").withColumn(name, F.coalesce(name, F.lit("train")))


def shuffled(key: Column, seed: int) -> Column:
    """Sort key of a seeded shuffle."""
    return F.xxhash64(F.lit(seed).cast("long"), key)


def first_n(rows: DataFrame, by: list, n: int | Column, *order) -> DataFrame:
    """The first ``n`` rows of each group in a total order; tasks drop the rest before they shuffle."""
    r = free_name(rows, "nth")
    return rows.withColumn(r, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(r) <= n).drop(r)


def round_robin(rows: DataFrame, stratum: str, limit: int, *order) -> DataFrame:
    """``limit`` rows that take turns between strata (in their order) while they last, with their ``turn`` from 1.

    Only ``limit`` rows of each stratum are kept before all are ordered.
    """
    r = free_name(rows, "nth")
    own = rows.withColumn(r, F.row_number().over(Window.partitionBy(stratum).orderBy(*order))).where(F.col(r) <= limit)
    turn = F.row_number().over(Window.orderBy(r, stratum))
    return own.withColumn("turn", turn).where(F.col("turn") <= limit).drop(r)


def mixture(rows: DataFrame, stratum: str, first, limit: int, share: float, *order) -> DataFrame:
    """``limit`` positions of which position ``i`` takes stratum ``first`` where the rounded share up to it grows; short sides repeat.

    Returns ``rows`` with ``position`` from 1. Halves round to even.
    """
    spark = rows.sparkSession
    i = F.col("position")
    upto = lambda x: F.bround(x * share, 0).cast("long")
    slots = spark.range(1, limit + 1).select(F.col("id").alias("position"))
    slots = slots.withColumn("own", upto(i) > upto(i - 1)).withColumn("k", F.when(F.col("own"), upto(i) - 1).otherwise(i - upto(i) - 1))
    r, own = free_name(rows, "nth"), F.col(stratum) == first
    kept = rows.withColumn("own", own).withColumn(r, F.row_number().over(Window.partitionBy("own").orderBy(*order)) - 1).where(F.col(r) < limit)
    sizes = kept.groupBy("own").agg(F.count("*").alias("size"))
    slots = slots.join(F.broadcast(sizes), "own").withColumn(r, F.pmod("k", "size"))
    return slots.select("position", "own", r).join(kept, ["own", r]).select("position", *rows.columns)


def batches(keys: DataFrame, key: str, size: int) -> DataFrame:
    """``(key, batch)``: distinct keys in order, ``size`` a batch, from 1.

    Keys are numbered by range: the sizes of the ranges before are added, so no task sorts them all.
    """
    spread = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = keys.select(key).where(F.col(key).isNotNull()).distinct()
    cuts = [c for c in own.approxQuantile(key, [i / spread for i in range(1, spread)], 0.01)] if dict(own.dtypes)[key] in ("bigint", "int", "double") else []
    part = sum((F.when(F.col(key) >= c, 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0))
    dealt = own.withColumn("part", part)
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    dealt = dealt.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy(key))).join(F.broadcast(counts.select("part", before.alias("before"))), "part")
    return dealt.select(key, (F.floor((F.col("r") + F.col("before") - 1) / size) + 1).alias("batch"))


def leading(rows: DataFrame, by: list[str], score: str, lead: float, *ties) -> DataFrame:
    """The best row of each group if it is alone or leads the next by ``lead``."""
    r, after = free_name(rows, "nth"), free_name(rows, "after")
    w = Window.partitionBy(*by).orderBy(F.desc(score), *ties)
    ranked = rows.withColumn(after, F.lead(score).over(w)).withColumn(r, F.row_number().over(w)).where(F.col(r) == 1)
    return ranked.where(F.col(after).isNull() | (F.col(score) - F.col(after) >= lead)).drop(r, after)


def alternating(rows: DataFrame, site: str, abstains: str, order: list[str]) -> DataFrame:
    """``rows`` with ``turn``: rounds over sites in order, in which each gives one row, by turns one that abstains and one that doesn't.

    The site at an even place begins with one that doesn't abstain, the next with one that does; a site whose wanted
    kind has run out gives the other, until it has none. The round of a row follows from how many of each kind its site
    has, so no round waits for the one before: the k-th of the kind that begins comes in round 2k, of the other in 2k + 1,
    but not later than after all of the other kind. ``turn`` counts from 1. ``order`` must order a site's rows fully.
    """
    from .compare import numbered

    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = rows.withColumn("_late", F.col(abstains).cast("int"))
    places = own.select(site).distinct().withColumn("_place", F.row_number().over(Window.orderBy(site)) - 1)
    kinds = own.groupBy(site).agg(F.count_if(F.col("_late") == 1).alias("_lates"), F.count_if(F.col("_late") == 0).alias("_others")).join(places, site)
    keys = [site, "_late"]
    own = numbered(own, keys, order, "_k", ranges(own, order[0], spread)).join(kinds, site)
    first = F.pmod(F.col("_place") + F.col("_late"), F.lit(2)) == 0
    k, rest = F.col("_k") - 1, F.when(F.col("_late") == 1, F.col("_others")).otherwise(F.col("_lates"))
    own = own.withColumn("_round", F.least(2 * k + F.when(first, 0).otherwise(1), rest + k))
    # One row per site and round; sites of a round are few enough to be ranked by their place among those that are left.
    sizes = own.groupBy("_round").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_round").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_round", before.alias("_before"))
    own = own.withColumn("_at", F.row_number().over(Window.partitionBy("_round").orderBy("_place"))).join(sizes, "_round")
    return own.select(*(F.col(f"`{c}`") for c in rows.columns), (F.col("_before") + F.col("_at")).alias("turn"))


def ranges(rows: DataFrame, key: str, parts: int) -> Column:
    """A coarse ascending number of ``key``, by quantiles, for ``numbered``; 0 for keys that aren't numbers."""
    if dict(rows.dtypes)[key] not in ("bigint", "int", "double"):
        return F.lit(0)
    cuts = sorted(set(rows.approxQuantile(key, [i / parts for i in range(1, parts)], 0.01)))
    return sum((F.when(F.col(key) >= c, 1).otherwise(0) for c in cuts), F.lit(0))

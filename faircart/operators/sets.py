"""Set operations and membership: queues, splits, retirement, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_queues(queues: list[DataFrame], key: str) -> tuple[DataFrame, DataFrame]:
    """The union of review queues, and the keys that stand in it more than once."""
    whole = queues[0]
    for q in queues[1:]:
        whole = whole.unionByName(q)
    return whole, whole.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def split_violations(splits: DataFrame, sites: DataFrame, site: str, split: str) -> DataFrame:
    """``(site, issue)``: sites in two splits, unknown sites, and sites without a split."""
    given = splits.groupBy(site).agg(F.countDistinct(split).alias("n"))
    both = given.join(sites.select(site, F.lit(True).alias("known")).distinct(), site, "full_outer")
    issue = F.when(F.col("n").isNull(), "unassigned").when(F.col("known").isNull(), "unknown").when(F.col("n") > 1, "overlap")
    return both.select(site, issue.alias("issue")).where("issue is not null")


def split_of(site: Column, splits: dict[str, list]) -> Column:
    """The first split that lists a site; null for none."""
    out = F.lit(None).cast("string")
    for name, members in reversed(splits.items()):
        out = F.when(site.isin(*members), name).otherwise(out)
    return out


def retire(active: DataFrame, retired: DataFrame, replaced: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of ``active`` that match ``replaced`` exactly move to ``retired``; doing it again changes nothing."""
    going = active.join(replaced.select(*key).distinct(), key, "left_semi")
    staying = active.join(replaced.select(*key).distinct(), key, "left_anti")
    new = going.join(retired.select(*key), key, "left_anti")
    return staying, retired.unionByName(new.select(*retired.columns))


def artefact_conflicts(rows: DataFrame, identity: list[str], value: str) -> DataFrame:
    """Identities that stand more than once: ``(identity, n, issue)``, conflict if their values differ, else duplicate."""
    seen = rows.groupBy(*identity).agg(F.count("*").alias("n"), F.min(value).alias("a"), F.max(value).alias("b")).where("n > 1")
    return seen.select(*identity, "n", F.when(F.col("a").eqNullSafe(F.col("b")), "duplicate").otherwise("conflict").alias("issue"))

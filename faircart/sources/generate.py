"""Generated relations: capture targets from sites and queries, and products for tests at any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import same_site, slugify


def expand_targets(sites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A page for every site and query of ``sites(site, host, url, queries)``, and the faults among them.

    ``{query}`` in the url is percent-encoded, ``{querySlug}`` slugged. Faults are page ids that repeat and urls on another host.
    """
    rows = sites.select("site", "host", "url", F.explode("queries").alias("query"))
    slug = slugify(F.col("query"))
    encoded = F.replace(F.url_encode("query"), F.lit("+"), F.lit("%20"))
    url = F.replace(F.replace("url", F.lit("{querySlug}"), slug), F.lit("{query}"), encoded)
    pages = rows.select("site", "host", "query", F.concat_ws("--", slugify(F.col("site")), slug).alias("page_id"), url.alias("url"))
    twice = pages.groupBy("page_id").agg(F.count("*").alias("n")).where("n > 1").select("page_id", F.lit("duplicate-page").alias("fault"))
    away = pages.where(~same_site(F.col("host"), F.parse_url("url", F.lit("HOST")))).select("page_id", F.lit("other-host").alias("fault"))
    return pages.drop("host"), twice.unionByName(away)


def synthetic_products(spark: SparkSession, n: int, per_page: int = 20, seed: int = 20260724) -> DataFrame:
    """``n`` products whose facts follow from their number, so that every expected answer is known.

    One in five abstains, one in four is a multipack, every tenth has one and a half units; two in three print a unit price, and one in
    seven of those has nothing else. Prices come from a hash of seed and number.
    """
    i = F.col("id")
    rows = spark.range(n).select(i.alias("product"), F.floor(i / per_page).alias("page"), F.pmod(i, F.lit(per_page)).alias("idx"))
    idx = F.col("idx")
    cents = F.pmod(F.xxhash64(F.lit(seed), "product"), F.lit(4_900)) + 100
    return rows.select(
        "product",
        "page",
        "idx",
        cents.alias("cents"),
        (idx % 5 == 0).alias("abstains"),
        F.when(idx % 4 == 3, (idx % 3 + 2)).otherwise(1).cast("int").alias("packs"),
        F.when(idx % 10 == 8, 1.5).otherwise((idx % 6 + 1).cast("double")).alias("quantity"),
        (idx % 3 != 0).alias("prints_rate"),
        ((idx % 3 != 0) & (idx % 7 == 2)).alias("rate_only"),
        F.when(idx % 10 == 2, "split").when(idx % 10 == 3, "sale").when(idx % 10 == 4, "secondary").otherwise("plain").alias("layout"),
    )


def structural_family(*parts) -> Column:
    """The parts of a layout that two pages must share to count as one family."""
    return F.concat_ws("|", *parts)

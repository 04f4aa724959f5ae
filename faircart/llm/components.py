"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, scratch_path


def _written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _sum(df: DataFrame) -> tuple[int, int]:
    row = df.agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")
    ).first()
    return row.n, int(row.h)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Smallest reachable node of every node that has an edge.

    Returns ``(node, component)``. Nodes may be of any orderable type. Null ends and loops
    are ignored (a node with nothing but loops is not returned). Every round is one
    aggregation with map-side combination and one join that adaptive execution can split,
    so a node with very many neighbours does not land whole in one task. Rounds are cut by
    tables in the shared folder; no edge or label reaches the driver, only two numbers per
    round do.
    """
    spark = edges.sparkSession
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, path = _written(e, "cc")
    last = _sum(e)
    while last[0]:
        # Large star: every larger neighbour of u points to u's smallest neighbour (or u).
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        large, large_path = _written(large, "cc")
        # Small star: every smaller neighbour of u, and u itself, point to u's smallest neighbour.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        small, small_path = _written(small, "cc")
        now = _sum(small)
        remove(spark, path)
        remove(spark, large_path)
        e, path = small, small_path
        if now == last:
            break
        last = now
    stars = e.groupBy("u").agg(F.min("v").alias("m"))
    return stars.select(F.col("u").alias("node"), F.col("m").alias("component")).unionByName(
        stars.select(F.col("m").alias("node"), F.col("m").alias("component")).distinct()
    )

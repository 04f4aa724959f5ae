"""Table access and the price texts that queries derive from numeric columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` over all cores by ``key``, before costly rules: a file of few splits leaves them to as few tasks."""
    spark = rows.sparkSession
    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return rows.repartition(spread, key)


def tasks_for(rows: DataFrame, most: int) -> int:
    """As many tasks as Spark is set to, or more, so that each has ``most`` of ``rows`` on average at most (a count from Parquet footers)."""
    spark = rows.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, -(-rows.count() // most))


def r4(x: Column) -> Column:
    """Four decimals, half up, computed the same way in both engines."""
    return F.floor(x * 10000 + 0.5) / 10000


def dollars(cents: Column) -> Column:
    """Whole cents as ``$d.dd``."""
    return F.concat(F.lit("$"), F.floor(cents / 100).cast("long"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def cents_of(x: Column) -> Column:
    return F.floor(x * 100 + 0.5).cast("long")


#: The same helpers for DuckDB.
SQL_MACROS = {
    "r4": lambda x: f"floor(({x}) * 10000 + 0.5) / 10000",
    "cents": lambda x: f"CAST(floor(({x}) * 100 + 0.5) AS BIGINT)",
    "dollars": lambda c: f"concat('$', ({c}) // 100, '.', lpad(CAST(({c}) % 100 AS VARCHAR), 2, '0'))",
}


def part_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card per part: name and size in ounces as title, retail price as current price."""
    part = table(spark, sf_dir, "part")
    return part.select(
        "p_partkey",
        "p_brand",
        "p_type",
        F.concat("p_name", F.lit(", "), "p_size", F.lit(" oz")).alias("title"),
        F.concat(F.lit("current price "), dollars(cents_of(F.col("p_retailprice")))).alias("card_text"),
        F.lit(None).cast("string").alias("price_text"),
    )


def rate_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line item's price per piece (in thousands) as a printed price per pound."""
    line = table(spark, sf_dir, "lineitem")
    rate = cents_of(F.col("l_extendedprice") / F.col("l_quantity") / 1000)
    return line.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", rate.alias("rate_cents"), F.concat(dollars(rate), F.lit("/lb")).alias("rate_text")
    )


RATE = SQL_MACROS["cents"]("l_extendedprice / l_quantity / 1000")


def registry():
    """Dictionaries of queries and their SQL, and a decorator that fills them."""
    queries, sql = {}, {}

    def query(name: str, text: str | None = None):
        def keep(f):
            queries[name] = f
            if text:
                sql[name] = text
            return f

        return keep

    return queries, sql, query

"""Cohorts of comparable products: groups, the lowest of N, and order by unit price in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import free_name

#: Rates closer than this are the same.
SAME = 0.0001


def comparison_groups(rows: DataFrame, minimum: int = 1) -> DataFrame:
    """``(compare_key, unit, dimension, count, label, sort_label)`` of ``rows(compare_key, unit, dimension)``."""
    from ..functions.units import label_of

    label = F.concat(F.lit("per "), label_of(F.col("unit")))
    groups = rows.where("compare_key is not null").groupBy("compare_key")
    groups = groups.agg(F.min("unit").alias("unit"), F.min("dimension").alias("dimension"), F.count("*").alias("count"))
    groups = groups.where(F.col("count") >= minimum).withColumn("label", label)
    return groups.withColumn("sort_label", F.concat(F.lit("Unit price "), F.col("label"), F.lit(": low to high")))


def lowest_of_n(rows: DataFrame, cohort: list[str], value: str = "cents", minimum: int = 3) -> DataFrame:
    """Rows at the minimum of their cohort, with ``lowest_of`` (its size); cohorts under ``minimum`` give none.

    A cohort's size and minimum are aggregated first, map-side, and joined back. A window over the
    cohort would bring all its rows to one task; this way a cohort of any size is spread, and adaptive
    execution broadcasts the cohort table only when it has turned out small.
    """
    known = rows.where(F.col(value).isNotNull())
    for c in cohort:
        known = known.where(F.col(c).isNotNull())
    least = free_name(rows, "least")
    sizes = known.groupBy(*cohort).agg(F.count("*").alias("lowest_of"), F.min(value).alias(least)).where(F.col("lowest_of") >= minimum)
    return known.join(sizes, cohort).where(F.col(value) - F.col(least) <= SAME).drop(least)


def sortable_counts(rows: DataFrame, parent: list[str], key: str = "compare_key", family: str = "family") -> DataFrame:
    """Per key, how many rows stand in families of two or more below one parent."""
    families = rows.where(F.col(key).isNotNull()).groupBy(*parent, key, family).agg(F.count("*").alias("n"))
    return families.where("n >= 2").groupBy(key).agg(F.sum("n").alias("sortable"))


def default_compare_key(rows: DataFrame, parent: list[str], key: str = "compare_key", family: str = "family") -> DataFrame:
    """The key with most sortable rows (ties by key), one row at most."""
    return sortable_counts(rows, parent, key, family).orderBy(F.desc("sortable"), key).limit(1)


def numbered(rows: DataFrame, keys: list[str], order: list, name: str, coarse) -> DataFrame:
    """``rows`` with ``name``, their number from 1 within ``keys`` in a total order.

    ``coarse`` is a column that never falls along ``order``. Only rows equal in it are sorted together; the sizes
    of the groups before are added, so that a hot key is numbered by many tasks.
    """
    part, size, before = (free_name(rows, n) for n in ("part", "size", "before"))
    dealt = rows.withColumn(part, coarse)
    sizes = dealt.groupBy(*keys, part).agg(F.count("*").alias(size))
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn(before, F.coalesce(F.sum(size).over(earlier), F.lit(0))).drop(size)
    own = Window.partitionBy(*keys, part).orderBy(*order)
    out = dealt.withColumn(name, F.row_number().over(own)).join(sizes, [*keys, part])
    return out.withColumn(name, (F.col(name) + F.col(before)).cast("long")).drop(part, before)


def slot_sort(
    rows: DataFrame, parent: list[str], family: str = "family", position: str = "pos", value: str = "cents", step: float = 10.0, run: int = 10_000
) -> DataFrame:
    """Adds ``new_pos`` and ``moved``: members of a family swap places among their own slots, by value.

    Families of one, and rows without a value, keep their place. Ties keep their order. Positions are unique in a parent.
    Rows are ranked together only within ``run`` positions and within ``step`` of the value.
    """
    rank, known = free_name(rows, "rank"), rows.where(F.col(value).isNotNull())
    keys = [*parent, family]
    places = numbered(known.select(*keys, F.col(position).alias("new_pos")), keys, ["new_pos"], rank, F.floor(F.col("new_pos") / run))
    moved = numbered(known, keys, [value, position], rank, F.floor(F.col(value) / step)).join(places, [*keys, rank])
    fixed = rows.where(F.col(value).isNull()).withColumn("new_pos", F.col(position))
    out = moved.select(*rows.columns, "new_pos").unionByName(fixed.select(*rows.columns, "new_pos"))
    return out.withColumn("moved", F.col("new_pos") != F.col(position))


def restore_order(rows: DataFrame, parent: list[str], position: str = "pos") -> DataFrame:
    return rows.orderBy(*parent, position)


def dedupe_products(rows: DataFrame, scope: list[str], position: str = "pos") -> DataFrame:
    """The first product of each lower-case title and display in a scope."""
    return first_by(rows, [*scope, F.lower("title"), "display"], position)


def first_by(rows: DataFrame, keys: list, *order) -> DataFrame:
    """The first row of each key in a total order; safe where ``min_by`` would pick any of equals.

    Spark keeps only the first rows of each task before it shuffles (a window group limit), so hot keys stay small.
    """
    name = free_name(rows, "nth")
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) == 1).drop(name)


def latest(rows: DataFrame, keys: list[str], time: str, *ties) -> DataFrame:
    """The newest row of each key; of equal times the first by ``ties``."""
    return first_by(rows, keys, F.desc(time), *ties)

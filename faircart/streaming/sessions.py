"""Changes on pages as streams: evidence filter, debouncing by session windows, newest state by key.

The same functions take a batch, which is how their results are checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import is_product_evidence
from ..operators.compare import latest


def product_changes(changes: DataFrame, text: str = "text", own: Column | None = None) -> DataFrame:
    """Changes that show product evidence; those of the page's own helpers (``own``) are left out."""
    kept = changes.where(is_product_evidence(F.col(text)))
    return kept if own is None else kept.where(~own)


def debounced(changes: DataFrame, key: str, time: str = "ts", gap: str = "650 milliseconds", late: str = "10 minutes") -> DataFrame:
    """One row for each run of changes of a key without a pause of ``gap``: ``(key, started, due, changes)``.

    ``due`` is when the pause is over. On a stream, rows leave in append mode once the watermark has passed them.
    """
    rows = changes.withWatermark(time, late) if changes.isStreaming else changes
    runs = rows.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("changes"))
    return runs.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("due"), "changes")


def status_counts(products: DataFrame, key: str, compare_key: str, least: int = 2) -> DataFrame:
    """``(key, products, groups, sortable_groups, sortable)`` of each page: a running state on a stream (update mode).

    Groups are exact; those of ``least`` products or more can be sorted. A page's products, whose keys are the state, are few.
    """
    held = products.groupBy(key).agg(F.collect_list(compare_key).alias("held"))
    sizes = F.transform(F.array_distinct("held"), lambda g: F.size(F.filter("held", lambda x: x == g)))
    held = held.select(key, F.size("held").cast("long").alias("products"), sizes.alias("sizes"))
    sortable = F.size(F.filter("sizes", lambda n: n >= least)).cast("long")
    return held.select(key, "products", F.size("sizes").cast("long").alias("groups"), sortable.alias("sortable_groups"), (F.col("products") >= least).alias("sortable"))


def newest(rows: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """The newest row of each key, of equal times the one with the smallest ``tie``.

    On a stream (update mode) the state of a key is its newest row, and a row is put out only where it takes that place:
    each batch costs what it brings, however large the table of all keys. On a batch it is ``latest``.
    """
    if not rows.isStreaming:
        return latest(rows, [key], time, tie)
    import pandas as pd

    columns = rows.columns
    t, e = columns.index(time), columns.index(tie)

    def step(_, frames, state):
        best = tuple(state.get) if state.exists else None
        found = False
        for f in frames:
            top = f.sort_values([time, tie], ascending=[False, True]).head(1)
            row = tuple(top.itertuples(index=False, name=None))[0]
            if best is None or (pd.Timestamp(row[t]), -row[e]) > (pd.Timestamp(best[t]), -best[e]):
                best, found = row, True
        if found:
            state.update(tuple(x.to_pydatetime() if isinstance(x, pd.Timestamp) else x.item() if hasattr(x, "item") else x for x in best))
            yield pd.DataFrame([best], columns=columns)

    return rows.groupBy(key).applyInPandasWithState(step, rows.schema, rows.schema, "update", "NoTimeout")


def keep_latest(path: str, keys: list[str], time: str, *ties):
    """A ``foreachBatch`` function that keeps the newest row of each key in a table at ``path``.

    The batch and the table are merged into a folder of the batch's own number, so that a repeated batch gives the same. It
    writes the whole table each time: for small tables. ``newest`` keeps state instead.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch if number == 0 else batch.unionByName(spark.read.parquet(f"{path}/{number - 1}"))
        latest(rows, keys, time, *ties).write.mode("overwrite").parquet(f"{path}/{number}")

    return merge

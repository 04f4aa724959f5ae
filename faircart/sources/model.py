"""The place where an extraction model plugs in: prompts out, answers back, in batches of a fixed size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = 32


def prompts(nodes: DataFrame, by: list[str]) -> DataFrame:
    """``(by, prompt)``: the nodes of each card as one line of JSON, in document order (a card's nodes are few)."""
    rows = nodes.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("node", "tag", "text"))).alias("nodes"))
    return rows.select(*by, F.to_json("nodes").alias("prompt"))


def answer(rows: DataFrame, make: Callable[[], Callable[[list[str]], list[str]]], size: int = BATCH, name: str = "answer") -> DataFrame:
    """``rows(prompt, ...)`` with a model's answers. ``make()`` loads the model once a task; it answers ``size`` prompts at a time."""
    schema = rows.select("*", F.lit("").alias(name)).schema
    at = rows.columns.index("prompt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for whole in batches:
            for i in range(0, whole.num_rows, size):
                b = whole.slice(i, size)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model(b.column(at).to_pylist()), pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)

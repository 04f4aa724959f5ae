"""A corpus pipeline over ``documents``: toxicity, near-duplicates, benchmark, personal data, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept. All but the last
return the columns of ``documents``, further columns included. Nulls in any column, empty and very long texts, repeated
rows and empty tables pass through every stage; a null text counts as empty and stays null until it is packed as the end
token alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faircart.llm import decontam, packing, pii, simhash, toxicity
from faircart.llm.common import materialise, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the string-kernel machine calls toxic go; without both kinds of labels, none or all do."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of texts linked by a Jaccard similarity of 0.8 over five-word shingles stays.

    It is the smallest by doc_id (null last), then the first as stored.
    """
    return simhash.deduplicate(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain four fifths of a test item's five-word shingles go; null and empty texts stay."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms are replaced in the texts; n_chars follows. A null text keeps its null n_chars."""
    out = pii.sanitise(docs)
    return out.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of at most 4096; every row gives one piece at least."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark", drop_benchmark),
    ("personal_data", sanitise),
    ("packing", pack),
]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

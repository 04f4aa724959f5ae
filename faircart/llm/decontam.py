"""Benchmark decontamination: size-partitioned containment MinHash with exact verification.

Test items are short and documents long, so resemblance says nothing; what counts is the share
of an item's word shingles that a document contains. Items are partitioned by size. An item
with ``n`` shingles in a partition that ends at size ``u`` is sketched by its
``floor((1 - t) * u) + slack`` smallest shingle hashes. A document that contains a share ``t``
of the item misses fewer shingles than the sketch has, so it hits the sketch; the number of
hits is the containment estimate that admits it as a candidate. Candidates are verified by
exact containment of the shingle strings. The sketch is long enough to lose no pair.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_arrow_column, free_name, materialise, scratch_path, table

WORD = re.compile(r"\w+")
#: Characters of test items that one pass over the documents looks for.
BLOCK_CHARS = 1 << 25
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of word characters."""
    return WORD.findall((text or "").lower())


def shingles_of(words: list[str], width: int) -> set[str]:
    """Distinct shingles; fewer words than ``width`` make one shingle of them all."""
    if len(words) <= width:
        return {" ".join(words)} if words else set()
    return {" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


class Sketches:
    """Containment index over a block of items, small enough to be sent to every task."""

    def __init__(self, items: list[tuple[int, str]], width: int, threshold: float, slack: int = 4):
        self.width, self.vocab = width, {}
        self.items: list[tuple[int, set[str], int, int]] = []  # id, shingles, hits to be a candidate, shared to match
        postings: dict[int, list[tuple[np.uint64, int]]] = defaultdict(list)  # by shingle length
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            parts, length = shingles_of(words, width), min(width, len(words))
            least = math.ceil(threshold * len(parts) - 1e-9)
            upper = 1 << (len(parts) - 1).bit_length()
            size = min(len(parts), math.floor((1 - threshold) * upper + 1e-9) + slack)
            hits = max(1, size - (len(parts) - least))
            for w in words:
                self.vocab.setdefault(w, len(self.vocab) + 1)
            for s in sorted(parts, key=lambda s: xxhash.xxh64_intdigest(s, 1))[:size]:
                ids = np.array([self.vocab[w] for w in s.split(" ")], np.uint64)
                postings[length].append((self.codes(ids, length)[0], len(self.items)))
            self.items.append((item_id, parts, hits, least))
        self.postings = {}
        for length, pairs in postings.items():
            pairs.sort(key=lambda p: int(p[0]))
            self.postings[length] = (
                np.array([p[0] for p in pairs], np.uint64),
                np.array([p[1] for p in pairs], np.int64),
            )

    @staticmethod
    def codes(ids: np.ndarray, length: int) -> np.ndarray:
        """A 64-bit code for each run of ``length`` word numbers."""
        n = len(ids) - length + 1
        code = np.zeros(n, np.uint64)
        for k in range(length):
            code = (code ^ ids[k : k + n]) * MIX
            code ^= code >> np.uint64(29)
        return code

    def matches(self, text: str | None) -> list[tuple[int, int, int]]:
        """``(item_id, shared shingles, item shingles)`` of every item the text contains to the threshold."""
        words = words_of(text)
        ids = np.fromiter(map(self.vocab.get, words, [0] * len(words)), np.uint64, len(words))
        out = []
        for length, (keys, item) in self.postings.items():
            if len(words) < length:
                continue
            known = np.convolve(ids == 0, np.ones(length, np.int64), "valid") == 0
            if not known.any():
                continue
            code = np.unique(self.codes(ids, length)[known])
            left, right = np.searchsorted(keys, code, "left"), np.searchsorted(keys, code, "right")
            spans = [(a, b) for a, b in zip(left.tolist(), right.tolist(), strict=True) if a < b]
            if not spans:
                continue
            found, hits = np.unique(np.concatenate([item[a:b] for a, b in spans]), return_counts=True)
            there = None
            for i, h in zip(found.tolist(), hits.tolist(), strict=True):
                item_id, parts, need, least = self.items[i]
                if h < need:
                    continue
                if there is None:
                    there = {" ".join(words[p : p + length]) for p in np.flatnonzero(known).tolist()}
                if (shared := len(parts & there)) >= least:
                    out.append((item_id, shared, len(parts)))
        return out


def block_number(items: DataFrame, chars: int) -> int:
    return (items.agg(F.sum(F.length("text"))).first()[0] or 0) // chars + 1


def item_blocks(benchmark: DataFrame, chars: int = BLOCK_CHARS):
    """Blocks of ``(item_id, text)`` of about ``chars`` characters each, one at a time on the driver."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    blocks = block_number(items, chars)
    for b in range(blocks):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()]


def contained_items(docs: DataFrame, benchmark: DataFrame, width: int = 5, threshold: float = 0.8, slack: int = 4, chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per pair of a document and a test item of which it contains ``threshold`` or more.

    Returns ``(doc_id, item_id, shared, shingles, containment)``. Null and empty texts match
    nothing. Items of fewer than ``width`` words are one shingle of all their words. Repeated
    document rows and repeated items give repeated pairs. Very long texts are read whole; an empty table on
    either side gives no rows. Other columns are ignored. Documents are not shuffled: each pass streams them
    once past the sketches of one block of items. One block at a time is held by the driver and the tasks: where there
    are several, each pass is written before the next.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    several, out, path = block_number(benchmark.where("text is not null"), chars) > 1, None, scratch_path(spark, "contained")
    for block in item_blocks(benchmark, chars):
        index = spark.sparkContext.broadcast(Sketches(block, width, threshold, slack))

        def make(index=index):
            return lambda texts: [index.value.matches(t.as_py()) for t in texts]

        found = add_arrow_column(rows, "text", "m", "array<struct<item_id:long,shared:long,shingles:long>>", make)
        out = found.select("doc_id", F.explode("m").alias("m")).select("doc_id", "m.*")
        if several:
            out.write.mode("append").parquet(path)
            index.destroy()
    if several:
        out = spark.read.schema(out.schema).parquet(path)
    return out.withColumn("containment", F.col("shared") / F.col("shingles"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 5, threshold: float = 0.8, chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs``, all columns kept, without the rows whose text contains a test item to ``threshold``.

    Null and empty texts stay; repeated rows stay or go together; without test items all rows stay, and an empty
    table stays empty. Where there are several blocks of items, what each has left is written before the next.
    """
    columns = docs.columns
    several = block_number(benchmark.where("text is not null"), chars) > 1
    for block in item_blocks(benchmark, chars):
        index = docs.sparkSession.sparkContext.broadcast(Sketches(block, width, threshold))

        def make(index=index):
            return lambda texts: [bool(index.value.matches(t.as_py())) for t in texts]

        name = free_name(docs, "hit")
        docs = add_arrow_column(docs, "text", name, "boolean", make).where(~F.col(name)).select(*(f"`{c}`" for c in columns))
        if several:
            docs = materialise(docs, "decontaminated")
            index.destroy()
    return docs


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items (five-word shingles, containment 0.8) inside all of ``documents``."""
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

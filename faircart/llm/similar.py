"""Classes of documents whose word shingles are alike by exact Jaccard similarity.

Candidates are what the SimHash operator links by its pigeonring filter, and what meets in MinHash bands:
fingerprints alone cannot reach a similarity of 0.8, where they differ in ten bits of 64 on average. All texts
that links or bands connect go to one group, each once, and inside a group shingle sets are compared
exactly. With 32 bands of four values a pair at similarity 0.8 shares no band with probability
(1 - 0.8**4)**32, about 5e-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, map_arrow, materialise, trimmed
from .components import connected_components
from .simhash import fingerprint_of, shingle_hashes
from .simhash import links as simhash_links

BANDS, BAND = 32, 4
#: Linked from 4 / 5 on, so that the test is in integers.
PART, WHOLE = 4, 5
#: Candidate groups above this many texts are compared as pairs of blocks in separate tasks.
BLOCK = 2048
FACTORS = np.random.default_rng(42).integers(0, 2**63, BANDS * BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    parts = list(shingle_hashes(text, words))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def band_keys(shingles: np.ndarray) -> list[int]:
    """One signed 64-bit key per band; none for an empty set."""
    if not len(shingles):
        return []
    least = np.full(len(FACTORS), 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 512):
        np.minimum(least, np.multiply.outer(FACTORS, shingles[at : at + 512]).min(axis=1), out=least)
    rows = least.reshape(BANDS, BAND)
    keys = np.array([xxhash.xxh64_intdigest(rows[b].tobytes(), b) for b in range(BANDS)], np.uint64)
    return keys.view(np.int64).tolist()


def link_similar(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Spanning edges of the components of "Jaccard similarity of 4/5 or more"; connected pairs are not compared again."""
    n, sizes, edges = len(sets), np.array([len(s) for s in sets]), []
    root = np.arange(n)
    for shift in range(1, n):
        if len(edges) == n - 1:
            break
        a, b = sizes[:-shift], sizes[shift:]
        maybe = (root[:-shift] != root[shift:]) & (np.minimum(a, b) * WHOLE >= np.maximum(a, b) * PART)
        for i in np.flatnonzero(maybe).tolist():
            j = i + shift
            if root[i] == root[j]:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both * WHOLE >= (int(sizes[i]) + int(sizes[j]) - both) * PART:
                edges.append((i, j))
                root[root == max(root[i], root[j])] = min(root[i], root[j])
    return edges


def links(texts: DataFrame, groups: DataFrame, words: int, block: int) -> DataFrame:
    """Edges ``(src, dst)`` between similar texts ``(node, text)`` of one group ``(node, component)``."""
    parts = F.ceil(F.count("*") / block).cast("int").alias("parts")
    met = texts.join(groups, "node").join(groups.groupBy("component").agg(parts), "component")
    met = met.withColumn("b", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    met = met.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("component", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "node", "text")
    met = met.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, nodes, sets = None, [], []

        def flush():
            found = link_similar(sets)
            src, dst = ([nodes[e[k]] for e in found] for k in range(2))
            return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

        for b in batches:
            for *group, node, text in zip(*(b.column(c).to_pylist() for c in range(4)), b.column(4), strict=True):
                if group != held:
                    yield flush()
                    held, nodes, sets = group, [], []
                nodes.append(node)
                sets.append(shingle_set(text.as_py(), words))
        yield flush()

    return met.mapInArrow(trimmed(run), "src long, dst long")


def classes(docs: DataFrame, words: int = 5, block: int = BLOCK) -> tuple[DataFrame, DataFrame, str, list[str]]:
    """``(marked, classes, key, more)``: all rows of ``docs(text)`` with a unique row key, and ``(key, component)``.

    Texts are linked if the sets of their ``words``-word shingles have a Jaccard similarity of 4/5
    or more; a class is a component of links. Null, empty and blank texts have the empty set and
    are one class. All columns stay as they are; ``key`` and ``more`` name the added ones.
    """
    key, digest, bands, mark = (free_name(docs, n) for n in ("row_key", "digest", "bands", "mark"))
    at = docs.columns.index("text")
    added = [(key, "long"), (digest, "binary"), (bands, "array<long>"), (mark, "long")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 33
        for b in batches:
            digests, keys, marks = [], [], []
            for x in b.column(at):
                shingles = shingle_set(x.as_py(), words)
                digests.append(xxhash.xxh128_digest(shingles.tobytes()))
                keys.append(band_keys(shingles))
                marks.append(fingerprint_of([shingles]))
            more = [
                pa.array(range(uid, uid + len(marks)), pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array(keys, pa.list_(pa.int64())),
                pa.array(np.array(marks, np.uint64).view(np.int64)),
            ]
            uid += len(marks)
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, *(n for n, _ in added)])

    marked = materialise(map_arrow(docs, run, added), "similar")
    sets = marked.groupBy(F.col(digest).alias("digest")).agg(F.min(key).alias("node"), F.first(bands).alias("bands"), F.first(mark).alias("fp"))
    sets = materialise(sets, "similar-sets")
    # Fingerprints that SimHash links share a key with the smallest of their component, as texts of one band do.
    prints = sets.select("fp").distinct()
    linked = connected_components(simhash_links(prints))
    prints = prints.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))
    alike = sets.select("node", "fp").join(prints, "fp").select("node", F.xxhash64(F.lit("simhash"), "component").alias("k"))
    keyed = sets.select("node", F.explode("bands").alias("k")).unionByName(alike)
    hubs = keyed.groupBy("k").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    groups = connected_components(keyed.join(hubs, "k").where("node <> hub"), "node", "hub")
    texts = marked.select(F.col(key).alias("node"), "text")
    linked = connected_components(materialise(links(texts, groups, words, block), "similar-links"))
    known = sets.select("node", "digest").join(linked, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    known = marked.select(F.col(key).alias("key"), F.col(digest).alias("digest")).join(known, "digest").select("key", "component")
    return marked, materialise(known, "similar-classes"), key, [key, digest, bands, mark]


def deduplicate(docs: DataFrame, words: int = 5, block: int = BLOCK) -> DataFrame:
    """``docs(doc_id, text)``, all columns kept, with one row of each class.

    It is the smallest by doc_id (null last), then the first as stored. Rows without an id are members like any others;
    null, empty and blank texts are one class; an empty table stays empty. Only row keys are joined: whole rows meet a
    written table of the keys that go.
    """
    marked, known, key, more = classes(docs, words, block)
    ids = marked.select(F.col(key).alias("key"), F.col("doc_id").alias("doc_id"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    first = known.join(ids, "key").groupBy("component").agg(F.min(order)["key"].alias("key"))
    gone = materialise(known.select("key").join(first.select("key"), "key", "left_anti").withColumnRenamed("key", key), "similar-gone")
    return marked.join(gone, key, "left_anti").select(*(f"`{c}`" for c in docs.columns))

"""Near-duplicate documents by SimHash, linked through pigeonring-filtered candidates.

A 64-bit fingerprint is cut into ``m`` ring segments. If two fingerprints differ in at most
``tau`` bits, at least ``e`` segments agree exactly, and some agreeing segment starts a chain
around the ring whose first ``l`` segments differ in at most ``floor(l * tau / m)`` bits, for
every ``l``. Index keys are the choices of ``e`` exact segments; a pair that meets in a bucket
must pass the chain test from one of them before the whole Hamming distance is taken. Both
steps are lossless.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table, trimmed
from .components import connected_components

#: (segments, exact segments) from coarse to fine; finer keys select better but number more.
LEVELS = ((5, 1), (6, 2), (7, 3), (8, 4))
#: Buckets above this many fingerprints are compared as pairs of blocks in separate tasks.
BLOCK = 8192
#: Low bits of an index key that hold segment values; the choice of segments stands above.
KEY_BITS = 40


def shingle_hashes(text: str | None, words: int = 4, seed: int = 42) -> Iterator[np.ndarray]:
    """64-bit hashes of all word shingles of a whole text, repeats included, in parts.

    A-Z are lower-cased, words are runs without ASCII white space; a text of fewer words is one
    shingle. Null, empty and blank texts give nothing.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(tokens) >= words:
        starts, ends = starts[: len(tokens) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), 16384):
        pairs = zip(starts[at : at + 16384].tolist(), ends[at : at + 16384].tolist(), strict=True)
        yield np.array([digest(joined[a:b], seed) for a, b in pairs], dtype="<u8")


def fingerprint_of(parts: Iterable[np.ndarray]) -> int:
    """SimHash of the hashes in all ``parts``: a bit is 1 if it is set in over half of them; 0 without hashes."""
    counts, total = np.zeros(64, np.int64), 0
    for h in parts:
        for at in range(0, len(h), 16384):
            bits = np.unpackbits(h[at : at + 16384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.int64)
        total += len(h)
    if not total:
        return 0
    set_bits = np.packbits(counts * 2 > total, bitorder="little")
    return int.from_bytes(set_bits.tobytes(), "little")


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """SimHash of a whole text as an unsigned integer.

    A-Z are lower-cased, words are runs without ASCII white space, shingles count with
    their repeats. Null, empty and blank texts give 0.
    """
    return fingerprint_of(shingle_hashes(text, words, seed))


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """``(doc_id, fp)`` per document row; ``fp`` is the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), words, seed) for t in b.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(trimmed(run), "doc_id long, fp long")


def choose_level(n: int) -> tuple[int, int]:
    """The coarsest level that gives each of ``n`` fingerprints about eight chance candidates at most."""
    for m, e in LEVELS:
        keys = len(list(itertools.combinations(range(m), e)))
        if n * keys / 2 ** (64 * e / m) <= 8:
            return m, e
    return LEVELS[-1]


class Ring:
    """Segment masks, index keys and chain masks for ``m`` segments, ``e`` exact ones and ``tau`` bits."""

    def __init__(self, m: int, e: int, tau: int):
        if tau > m - e:
            raise ValueError("more bits may differ than m - e segments can take up")
        cuts = [round(i * 64 / m) for i in range(m + 1)]
        self.m, self.tau = m, tau
        self.segments = [(a, b - a) for a, b in itertools.pairwise(cuts)]
        self.combos = list(itertools.combinations(range(m), e))
        bits = [((1 << w) - 1) << a for a, w in self.segments]
        chains = np.zeros((len(self.combos), e, m), np.uint64)
        for c, combo in enumerate(self.combos):
            for s, start in enumerate(combo):
                mask = 0
                for length in range(m):
                    mask |= bits[(start + length) % m]
                    chains[c, s, length] = mask
        self.chains = chains
        self.budgets = [(length * tau) // m for length in range(1, m + 1)]

    def keys(self, fp):
        """Array column with one 64-bit key per choice of exact segments."""
        out = []
        for c, combo in enumerate(self.combos):
            key = F.lit(c).cast("long")
            for a, w in (self.segments[i] for i in combo):
                part = F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << w) - 1))
                key = F.shiftleft(key, w).bitwiseOR(part)
            out.append(F.shiftleft(key, KEY_BITS - sum(self.segments[i][1] for i in combo)))
        return F.array(*out)

    def passes(self, x: np.ndarray, combo: np.ndarray) -> np.ndarray:
        """Which differences ``x`` have a chain within budget from an exact segment and at most ``tau`` bits."""
        ok = np.zeros(len(x), bool)
        for s in range(self.chains.shape[1]):
            left = np.flatnonzero(~ok)
            for length in range(1, self.m):
                part = np.bitwise_count(x[left] & self.chains[combo[left], s, length])
                left = left[part <= self.budgets[length]]
            ok[left] = True
        return ok & (np.bitwise_count(x) <= self.tau)


def link_sorted(group: np.ndarray, combo: np.ndarray, fp: np.ndarray, ring: Ring) -> list[tuple[int, int]]:
    """Star edges that connect, inside each run of equal ``group``, whatever ``ring`` links.

    Members already connected are not compared again, and only a spanning star leaves:
    at most one edge a row, however many pairs a bucket of near copies holds.
    """
    n = len(fp)
    root = np.arange(n)

    def settle() -> None:
        nonlocal root
        while not np.array_equal(root, up := root[root]):
            root = up

    at, shift = np.arange(n), 1
    while True:
        at = at[at + shift < n]
        at = at[group[at] == group[at + shift]]
        if not len(at):
            break
        new = at[root[at] != root[at + shift]]
        if len(new):
            new = new[ring.passes(fp[new] ^ fp[new + shift], combo[new])]
        for i in new.tolist():
            a, b = i, i + shift
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            root[max(a, b)] = min(a, b)
        if len(new):
            settle()
        shift += 1
    moved = np.flatnonzero(root != np.arange(n))
    signed = fp.view(np.int64)
    return list(zip(signed[moved].tolist(), signed[root[moved]].tolist(), strict=True))


def links(distinct: DataFrame, tau: int = 4, level: tuple[int, int] | None = None, block: int = BLOCK) -> DataFrame:
    """Edges ``(src, dst)`` whose components are those of "differ in at most ``tau`` bits".

    ``distinct`` holds each fingerprint once in column ``fp``. Buckets of more than ``block``
    fingerprints are dealt out as pairs of blocks, so no task gets a whole large bucket.
    """
    m, e = level or choose_level(distinct.count())
    ring = Ring(m, e, tau)
    keyed = distinct.select("fp", F.explode(ring.keys(F.col("fp"))).alias("k"))
    counts = keyed.groupBy("k").agg(F.count("*").alias("n")).where("n > 1")
    met = keyed.join(counts, "k")
    parts = F.ceil(F.col("n") / block).cast("int")
    met = met.withColumn("b", F.pmod(F.xxhash64("fp"), parts).cast("int"))
    met = met.withColumn("o", F.explode(F.sequence(F.lit(0), parts - 1)))
    met = met.select("k", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "fp")
    met = met.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        k, i, j, fp = (pa.Table.from_batches(held).column(c).to_numpy() for c in range(4))
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        found = link_sorted(np.cumsum(new), k >> KEY_BITS, fp.view(np.uint64), ring)
        src, dst = zip(*found, strict=True) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    return met.mapInArrow(trimmed(run), "src long, dst long")


def near_duplicates(docs: DataFrame, words: int = 4, tau: int = 4, seed: int = 42) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` per row of ``docs(doc_id, text)``.

    Null or blank texts have fingerprint zero and are linked like any other. Repeated rows and
    repeated ids keep their rows. A null id stays null and is never a component's smallest id
    (a component of nothing but null ids has component_id null). Other columns are ignored; an
    empty table gives an empty result.
    """
    fps = materialise(fingerprints(docs, words, seed), "simhash")
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    nodes = connected_components(links(distinct.select("fp"), tau))
    known = distinct.join(nodes.withColumnRenamed("node", "fp"), "fp", "left")
    known = known.select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = known.join(least, "component").select("fp", "component_id")
    out = fps.join(classes, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, words: int = 5) -> DataFrame:
    """One row of each class of texts alike at 0.8 or more over ``words``-word shingles, see ``similar.deduplicate``."""
    from .similar import deduplicate

    return deduplicate(docs, words)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash near-duplicate classes of the whole ``documents`` table."""
    return near_duplicates(table(spark, sf_dir, "documents"))

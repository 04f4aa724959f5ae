"""Substring deduplication: word windows that an earlier document holds are cut out of later ones.

Every window of a fixed number of words has a Rabin-Karp hash, of words that are Rabin-Karp hashes of their bytes: 64 bits,
and 32 more from another base. Were they random, one of ten trillion windows would be taken for another with a chance of
one in a thousand. Documents
are dealt into chunks, which are ranges of their ids. Each task sends the distinct hashes it has seen of a chunk, sorted
and as differences, to the owner of that part of the hash space; the owner counts each hash over chunks and answers a
chunk with the hashes that an earlier chunk holds. Documents then meet the answers of their chunk, repeats inside the
chunk are found on the spot, and repeated windows merge into maximal removal intervals.

A hash travels once per task and chunk, so a passage that a third of all documents share is one entry there. An id that
holds very many rows is a chunk range of its own, and its rows, which don't remove each other, are split further.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Bytes of text in a chunk of documents, and of the text whose windows one owner counts.
CHUNK_BYTES = 1 << 23
#: Windows that a task gathers before it sends them on.
GATHERED = 1 << 20
#: Bytes of a text whose words are hashed at a time.
PIECE = 1 << 16
SPACES = re.compile(rb"[\x20\x09-\x0D]")
IS_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
BYTE_VALUES = np.random.default_rng(13).integers(0, 1 << 64, 256, np.uint64)
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))


class Hashes:
    """Rabin-Karp hashes of a text's words, over bytes, and of all its windows, over words, in 64-bit arithmetic."""

    def __init__(self, window: int):
        self.window = window
        self.powers = [(np.ones(1, np.uint64), np.ones(1, np.uint64))] * 2

    def _powers(self, which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """``BASES[which]`` to the powers 0 to n - 1, and their inverses."""
        if len(self.powers[which][0]) < n:
            size = 1 << (n - 1).bit_length()
            out = []
            for base in (int(BASES[which]), pow(int(BASES[which]), -1, 1 << 64)):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                out.append(np.multiply.accumulate(p))
            self.powers[which] = tuple(out)
        up, down = self.powers[which]
        return up[:n], down[:n]

    def _spans(self, which: int, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The polynomial of ``values`` over each span, by sums from the beginning, wherever the span stands."""
        up, down = self._powers(which, len(values) + 1)
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:-1], out=sums[1:])
        return (sums[end] - sums[start]) * down[start]

    def words(self, text: bytes) -> list[np.ndarray]:
        """Two values of each word."""
        out = [[np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]]
        at = 0
        while at < len(text):
            more = SPACES.search(text, at + PIECE)
            piece = np.frombuffer(text[at : more.start() if more else len(text)], np.uint8)
            at += len(piece)
            space = np.concatenate(([True], IS_SPACE[piece], [True]))
            edges = np.flatnonzero(space[1:] != space[:-1])
            values = BYTE_VALUES[piece]
            for which in range(2):
                x = self._spans(which, values, edges[::2], edges[1::2])
                x = (x ^ (x >> np.uint64(32))) * BASES[1 - which]
                out[which].append(x ^ (x >> np.uint64(29)))
        return [np.concatenate(x) for x in out]

    def of(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """``(64 bits, 32 more)`` of each window; equal windows have equal values wherever they stand."""
        words = self.words(text or b"")
        start = np.arange(max(0, len(words[0]) - self.window + 1))
        key, more = (self._spans(which, words[which], start, start + self.window) for which in range(2))
        return key, (more >> np.uint64(32)).astype(np.uint32)


def later(key: np.ndarray, check: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Marks the entries whose ``(key, check)`` another entry of smaller ``order`` has as well."""
    marks = np.zeros(len(key), bool)
    by = np.argsort(key)
    same = np.diff(key[by]) == 0
    met = np.zeros(len(key), bool)
    met[1:] |= same
    met[:-1] |= same
    at = by[met]
    at = at[np.lexsort((order[at], check[at], key[at]))]
    if not len(at):
        return marks
    starts = np.flatnonzero(np.r_[True, (np.diff(key[at]) != 0) | (check[at][1:] != check[at][:-1])])
    first = np.repeat(order[at][starts], np.diff(np.r_[starts, len(at)]))
    marks[at] = order[at] > first
    return marks


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as differences, byte by byte, so that the leading zeros lie together."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def distinct_sorted(key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.argsort(key)
    key, check = key[by], check[by]
    same = np.r_[False, np.diff(key) == 0]
    if same.any():
        by = np.lexsort((check, key))
        key, check = key[by], check[by]
        new = np.r_[True, (np.diff(key) != 0) | (check[1:] != check[:-1])]
        key, check = key[new], check[new]
    return key, check


def chunk_columns(docs: DataFrame, size: int) -> tuple[Column, Column, int]:
    """``(chunk, split, parts)``: the range of ids a row is in, where that range is one id a split by text, and the number of parts of ``size`` bytes.

    Ranges come from quantiles of the ids, eight bytes for each chunk. Rows without an id are the last range.
    """
    some = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n"), F.count("doc_id").alias("ids")).first()
    parts = int(some.bytes or 0) // size + 1
    ends: list[int] = []
    if parts > 1 and some.ids:
        ends = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], max(10_000, 4 * parts))).first()[0]
    hot = {e for a, e in zip(ends, ends[1:], strict=False) if a == e}
    bounds = np.array(sorted(set(ends) | {e - 1 for e in hot}), np.int64)
    splits = np.ones(len(bounds) + 2, np.int32)
    for e in hot:
        splits[np.searchsorted(bounds, e)] = ends.count(e) + 1
    splits[-1] = max(1, (some.n - some.ids) * parts // max(1, some.n) + 1)

    @F.arrow_udf("struct<chunk:int,splits:int>")
    def place(ids: pa.Array) -> pa.Array:
        at = np.searchsorted(bounds, ids.fill_null(0).to_numpy(), "left")
        at[ids.is_null().to_numpy(zero_copy_only=False)] = len(bounds) + 1
        return pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(splits[at])], ["chunk", "splits"])

    found = place(F.col("doc_id"))
    return found["chunk"], F.pmod(F.xxhash64("text"), found["splits"]).cast("int"), parts


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of bytes other than the space and 09 to 0D."""
    return (text or b"").split()


def gather(window: int, owners: int):
    """A task's distinct window hashes by chunk and owner: rows ``(owner, chunk, split, keys, checks)``."""
    width = np.uint64(min((1 << 64) // owners + 1, (1 << 64) - 1))
    names = ["owner", "chunk", "split", "keys", "checks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, n = Hashes(window), defaultdict(list), 0

        def flush():
            rows = []
            for (chunk, split), parts in held.items():
                key, check = distinct_sorted(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                owner = (key // width).astype(np.int64)
                cuts = np.flatnonzero(np.diff(owner)) + 1
                for k, c in zip(np.split(key, cuts), np.split(check, cuts), strict=True):
                    rows.append((int(k[0] // width), chunk, split, pack_keys(k), c.tobytes()))
            held.clear()
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            for at in range(0, len(rows), 1000):
                columns = zip(*rows[at : at + 1000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        for b in batches:
            texts = b.column(2).cast(pa.binary())
            for chunk, split, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts, strict=True):
                found = hashes.of(text.as_py())
                if len(found[0]):
                    held[chunk, split].append(found)
                    n += len(found[0])
                if n >= GATHERED:
                    yield from flush()
                    n = 0
        yield from flush()

    return run


def count_owner(rows: pa.Table) -> pa.Table:
    """Of one owner's rows, those hashes of each that a smaller chunk holds as well."""
    keys = [unpack_keys(x.as_py()) for x in rows["keys"]]
    checks = [np.frombuffer(x.as_py(), np.uint32) for x in rows["checks"]]
    size = [len(k) for k in keys]
    marks = later(np.concatenate(keys), np.concatenate(checks), np.repeat(rows["chunk"].to_numpy(), size))
    marks = np.split(marks, np.cumsum(size)[:-1])
    some = [i for i, m in enumerate(marks) if m.any()]
    return pa.table(
        {
            "chunk": rows["chunk"].take(pa.array(some, pa.int64())),
            "split": rows["split"].take(pa.array(some, pa.int64())),
            "keys": pa.array([pack_keys(keys[i][marks[i]]) for i in some], pa.binary()),
            "checks": pa.array([checks[i][marks[i]].tobytes() for i in some], pa.binary()),
        }
    )


def intervals(marks: np.ndarray, window: int) -> tuple[list[int], list[int]]:
    """Starts and ends (exclusive), in words, of the maximal intervals that the marked windows cover."""
    at = np.flatnonzero(marks)
    if not len(at):
        return [], []
    cut = np.flatnonzero(np.diff(at) > window)
    return at[np.r_[0, cut + 1]].tolist(), (at[np.r_[cut, len(at) - 1]] + window).tolist()


def cut_out(window: int):
    """A chunk's rows and answers: rows ``(doc_id, n_words, n_removed, spans, kept)``."""
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        hashes = Hashes(window)
        ids = docs["doc_id"].to_pylist()
        rank = {d: i for i, d in enumerate(sorted({d for d in ids if d is not None}))} | {None: len(ids)}
        texts = docs["text"].cast(pa.binary())
        found = [hashes.of(t.as_py()) for t in texts]
        size = [len(f[0]) for f in found]
        known = [unpack_keys(x.as_py()) for x in answers["keys"]]
        order = np.concatenate([np.repeat(np.array([rank[d] for d in ids], np.int64), size), np.full(sum(map(len, known)), -1)])
        key = np.concatenate([f[0] for f in found] + known) if ids else np.zeros(0, np.uint64)
        check = np.concatenate([f[1] for f in found] + [np.frombuffer(x.as_py(), np.uint32) for x in answers["checks"]])
        marks = np.split(later(key, check, order)[: sum(size)], np.cumsum(size)[:-1]) if ids else []
        n_words, removed, cuts, kept = [], [], [], []
        for text, m in zip(texts, marks, strict=True):
            words = words_of(text.as_py())
            starts, ends = intervals(m, window)
            rest = [words[a:b] for a, b in zip([0, *ends], [*starts, len(words)], strict=True)]
            n_words.append(len(words))
            removed.append(sum(ends) - sum(starts))
            cuts.append([{"start": a, "end": b} for a, b in zip(starts, ends, strict=True)])
            kept.append(b" ".join([w for part in rest for w in part]))
        return pa.table(
            {
                "doc_id": docs["doc_id"],
                "n_words": pa.array(n_words, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "spans": pa.array(cuts, spans),
                "kept": pa.array(kept, pa.binary()).cast(pa.string()),
            }
        )

    return run


def remove_repeats(docs: DataFrame, window: int = 13, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``(doc_id, n_words, n_removed, spans, kept)``.

    ``spans`` are the maximal intervals of words (end exclusive) that are covered by windows which a document of smaller
    ``doc_id`` holds too, judged on the input; ``kept`` is the other words, joined by one space. Rows of one id don't
    remove each other, so repeated rows all stay as the first would. Rows without an id come after all others: they lose
    what others hold and take nothing from them or from each other. A null or empty text, or one of fewer words than a
    window, loses nothing. An empty table gives no rows; further columns are ignored. A text is read whole and is the
    largest thing in memory besides a chunk of about ``chunk_bytes``: some 50 bytes a word of the longest text.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunk, split, parts = chunk_columns(docs, chunk_bytes)
    dealt = docs.select(chunk.alias("chunk"), split.alias("split"), "doc_id", "text")
    sent = dealt.select("chunk", "split", "text").mapInArrow(gather(window, parts), "owner int, chunk int, split int, keys binary, checks binary")
    answers = sent.groupBy("owner").applyInArrow(count_owner, "chunk int, split int, keys binary, checks binary")
    out = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string"
    both = dealt.groupBy("chunk", "split").cogroup(answers.groupBy("chunk", "split"))
    return both.applyInArrow(cut_out(window), out)


def op13_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 13-word windows that an earlier document holds."""
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

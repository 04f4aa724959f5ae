"""Best-fit packing of tokenised documents after Martello-Toth dominance reduction.

Pieces of one length are interchangeable, so the whole decision needs only a histogram with
one counter per length (4096 at most, whatever the corpus). On it, item sets that provably
dominate every alternative for their largest member are fixed for good, the instance shrinks,
and best fit decreasing places the rest. The plan is a list of runs "this pattern of lengths,
so many times"; documents are dealt to its slots by their rank within their length.
"""

from __future__ import annotations

import bisect
import re
import struct
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table, trimmed

CAPACITY, END_ID = 4096, 1
TOKENIZER = "word_bpe_49k.json"
#: Words a worker keeps the ids of; beyond it the cache starts anew.
CACHE_WORDS = 300_000
#: Control characters that str.split takes for white space and the tokenizer does not.
ODD = "\x1c\x1d\x1e\x1f"
#: Marks that end a word; between a letter or digit and these the tokenizer always cuts.
MARKS = ".,!?;:%&*$#|"
#: Letters whose composition and lower case need no look at their neighbours.
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Byte-level BPE writes each byte as a character; these are the bytes outside ASCII that it moves.
SHOWN = {b: 256 + 33 + 1 + i for i, b in enumerate([*range(0x80, 0xA1), 0xAD])}

_WORKER: dict = {}


class WordEncoder(dict):
    """Ids of texts as little-endian 32-bit bytes, word by word; the mapping caches words.

    The tokenizer drops white space and never joins across it, so a text's ids are its words'
    ids in turn. A word of plain letters with marks behind it is two tokens to the tokenizer's
    splitter, so the letters go to its merges at once; all other words go through the whole of it.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge, self.cores = self.tokenizer.model.tokenize, {}

    def _ids(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        core = word.rstrip(MARKS)
        if LETTERS.fullmatch(core):
            low = core.lower()
            ids = self.cores.get(low)
            if ids is None:
                shown = low if low.isascii() else low.encode().decode("latin-1").translate(SHOWN)
                ids = self.cores[low] = b"".join([t.id.to_bytes(4, "little") for t in self.merge(shown)])
            if len(core) != len(word):
                ids += self[word[len(core) :]]
        else:
            ids = self._ids(word)
        self[word] = ids
        return ids

    def forget(self) -> None:
        """Leave out all words; the tokenizer stays."""
        self.clear()
        self.cores.clear()

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        for text in texts:
            text = text or ""
            if any(c in text for c in ODD):
                yield self._ids(text)
                continue
            if len(self) > CACHE_WORDS:
                self.forget()
            yield b"".join(map(self.__getitem__, text.split()))


def encoder(path: str) -> WordEncoder:
    """The worker process's encoder for a tokenizer file."""
    if path not in _WORKER:
        _WORKER[path] = WordEncoder(path)
    return _WORKER[path]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``(part, rank, doc_id, piece, start, length, ids_crc32)``: every document's ids cut to ``capacity``.

    ``part`` is the task that made the piece and ``rank`` its number, from 0, among the pieces of its length there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens, part_id, end = encoder(path), TaskContext.get().partitionId(), struct.pack("<I", end_id)
        made: Counter = Counter()
        for b in batches:
            rows = []
            for doc_id, ids in zip(b.column(0).to_pylist(), tokens.encode(b.column(1).to_pylist()), strict=True):
                ids += end
                for at in range(0, len(ids), 4 * capacity):
                    part = ids[at : at + 4 * capacity]
                    length = len(part) // 4
                    rows.append((part_id, made[length], doc_id, at // (4 * capacity), at // 4, length, zlib.crc32(part)))
                    made[length] += 1
            if rows:
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "rank", "doc_id", "piece", "start", "length", "ids_crc32"])
        tokens.forget()  # the worker may go on with other stages

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(trimmed(run), "part int, rank long, doc_id long, piece int, start long, length long, ids_crc32 long")


Run = tuple[tuple[int, ...], int]


def dominating_set(counts: dict[int, int], sizes: list[int], j: int, capacity: int) -> tuple[int, ...] | None:
    """A set with item ``j`` that dominates every feasible set with ``j``, or None.

    ``sizes`` is the sorted list of sizes that remain, ``counts`` how many of each.
    """
    left, r = lambda s: counts[s] - (s == j), capacity - j
    fit = sizes[: bisect.bisect_right(sizes, r)]
    fit = fit[:-1] if fit and fit[-1] == j and not left(j) else fit
    fit = fit if not (fit and not left(fit[-1])) else fit[:-1]
    if not fit:
        return (j,)  # nothing else fits
    k = fit[-1]
    if k == r:
        return (j, k)  # a perfect fit
    smallest = []
    for s in fit:
        smallest += [s] * min(3 - len(smallest), left(s))
        if len(smallest) == 3:
            break
    if len(smallest) < 2 or sum(smallest[:2]) > r:
        return (j, k)  # one more item at most: the largest
    if len(smallest) == 3 and sum(smallest) <= r:
        return None
    # Two more items at most: the largest and the largest beside it, if no pair's smaller member exceeds that one.
    beside = [s for s in fit[: bisect.bisect_right(fit, r - k)] if left(s) > (s == k)]
    if not beside:
        return None
    b, most = beside[-1], 0
    for i, s in enumerate(fit):
        if left(s) >= 2 and 2 * s <= r:
            most = s
        elif i + 1 < len(fit) and s + fit[i + 1] <= r:
            most = s
    return (j, k, b) if most <= b else None


def reduce_instance(histogram: dict[int, int], capacity: int) -> tuple[list[Run], dict[int, int]]:
    """Martello-Toth reduction: the sets fixed for good, and what remains to pack."""
    counts, fixed = {s: n for s, n in histogram.items() if n}, []
    sizes, again = sorted(counts), True
    while again:
        again = False
        for j in sorted(counts, reverse=True):
            while counts.get(j):
                found = dominating_set(counts, sizes, j, capacity)
                if not found:
                    break
                need = Counter(found)
                times = min(counts[s] // c for s, c in need.items())
                # Away from exhaustion the sizes that remain stay the same, and so does the proof.
                times = times if len(found) == 1 else max(1, times - 1)
                fixed.append((tuple(sorted(found, reverse=True)), times))
                again = True
                for s, c in need.items():
                    counts[s] -= c * times
                    if not counts[s]:
                        del counts[s]
                        sizes.pop(bisect.bisect_left(sizes, s))
    return fixed, counts


def best_fit(histogram: dict[int, int], capacity: int) -> list[Run]:
    """Best fit decreasing over a histogram, equal bins handled together."""
    open_bins: dict[int, list[Run]] = defaultdict(list)  # by room left
    rooms: list[int] = []

    def put(pattern: tuple[int, ...], times: int, room: int) -> None:
        if times:
            if not open_bins[room]:
                bisect.insort(rooms, room)
            open_bins[room].append((pattern, times))

    for s in sorted(histogram, reverse=True):
        n = histogram[s]
        while n:
            at = bisect.bisect_left(rooms, s)
            if at == len(rooms):
                pattern, times, room = (), -(-n // (capacity // s)), capacity
            else:
                room = rooms[at]
                pattern, times = open_bins[room].pop()
                if not open_bins[room]:
                    rooms.pop(at)
            each = room // s
            full = min(times, n // each)
            put(pattern + (s,) * each, full, room - each * s)
            n, times = n - full * each, times - full
            if times and n:
                some = min(n, each)
                put(pattern + (s,) * some, 1, room - some * s)
                n, times = n - some, times - 1
            put(pattern, times if pattern else 0, room)
    return [run for room in sorted(open_bins) for run in open_bins[room]]


def pack_histogram(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Runs ``(pattern of lengths, times)`` that hold every item of the histogram."""
    fixed, rest = reduce_instance(histogram, capacity)
    return fixed + best_fit(rest, capacity)


class Slots:
    """Where the piece of a given length and rank goes."""

    def __init__(self, runs: list[Run]):
        rows, rank, sequence = defaultdict(list), Counter(), 0
        for pattern, times in runs:
            offset = 0
            for s, c in Counter(pattern).items():
                rows[s].append((rank[s], sequence, c, offset))
                rank[s] += c * times
                offset += c * s
            sequence += times
        self.sequences, self.rows = sequence, {s: np.array(r, np.int64).T for s, r in rows.items()}

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        for s in np.unique(length).tolist():
            own = np.flatnonzero(length == s)
            first, base, each, start = self.rows[s]
            at = np.searchsorted(first, rank[own], "right") - 1
            step = rank[own] - first[at]
            sequence[own], offset[own] = base[at] + step // each[at], start[at] + step % each[at] * s
        return sequence, offset


def pack_pieces(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``items(part, rank, length, ...)`` of ``pieces`` with ``sequence_id`` and ``offset``.

    ``items`` must be a written table, as it is read three times. The histogram and the plan
    are bounded by ``capacity`` alone. A piece's rank among all of its length is its rank in its part plus the pieces
    of the parts before: one small row per part and length is summed, and no length is sorted or gathered.
    """
    counts = items.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = items.sparkSession.sparkContext.broadcast(Slots(pack_histogram(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = items.join(firsts, ["part", "length"]).withColumn("rank", F.col("first") + F.col("rank")).drop("part", "first")
    out = ranked.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema
    at_length, at_rank = ranked.columns.index("length"), ranked.columns.index("rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            placed = slots.value.place(b.column(at_length).to_numpy(), b.column(at_rank).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, placed)], names=out.names)

    return ranked.mapInArrow(trimmed(run), out).drop("rank")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pack ``docs(doc_id, text)`` into sequences of at most ``capacity`` tokens.

    Returns ``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``. A null or empty
    text is the end id alone. Repeated rows and null ids are packed like any others; other
    columns are ignored; an empty table gives no rows.
    """
    if path is None:
        import public_tokenizers

        path = str(public_tokenizers.path(TOKENIZER))
    items = materialise(pieces(docs, path, capacity), "pieces")
    return pack_pieces(items, capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of at most 4096 tokens."""
    return pack(table(spark, sf_dir, "documents"))

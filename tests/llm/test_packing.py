import itertools
import random
import struct
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from faircart.llm import packing


def optimum(sizes, capacity):
    """Fewest bins, by search with memory."""
    from functools import cache

    @cache
    def best(left):
        if not left:
            return 0
        first, rest = left[0], left[1:]
        found = 99
        for n in range(len(rest) + 1):
            for chosen in {c for c in itertools.combinations(rest, n) if first + sum(c) <= capacity}:
                after = list(rest)
                for c in chosen:
                    after.remove(c)
                found = min(found, 1 + best(tuple(after)))
        return found

    return best(tuple(sorted(sizes, reverse=True)))


def test_reduction_keeps_the_optimum():
    rng = random.Random(2)
    fixed_some = 0
    for _ in range(250):
        sizes = [rng.choice([rng.randint(1, 20), rng.randint(5, 12)]) for _ in range(rng.randint(1, 8))]
        fixed, rest = packing.reduce_instance(Counter(sizes), 20)
        held = Counter()
        for pattern, times in fixed:
            assert sum(pattern) <= 20
            for s in pattern:
                held[s] += times
        assert held + Counter(rest) == Counter(sizes)
        left = list(Counter(rest).elements())
        assert sum(t for _, t in fixed) + optimum(left, 20) == optimum(sizes, 20), sizes
        fixed_some += bool(fixed)
    assert fixed_some > 200


def test_packing_a_histogram():
    rng = random.Random(4)
    histogram = Counter(min(4096, int(rng.lognormvariate(5.5, 1.6)) + 1) for _ in range(30_000))
    runs = packing.pack_histogram(histogram)
    held = Counter()
    for pattern, times in runs:
        assert sum(pattern) <= 4096
        for s in pattern:
            held[s] += times
    assert held == histogram
    least = -(-sum(s * n for s, n in histogram.items()) // 4096)
    assert sum(t for _, t in runs) <= least * 1.01 + 1


@pytest.fixture(scope="module")
def path():
    return str(pytest.importorskip("public_tokenizers").path(packing.TOKENIZER))


def test_word_encoder(path):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    texts = ["It's a DOG, isn't it?!! x.'s", "é é ́x Σς. 12.5%, a\x1cb", "<|endoftext|> a<|endoftext|>b|", "", None]
    texts += ["中文 字,", "don't.''  n m\x85k", "a.b,c! ÀÉ. ½, ²! _x_. ퟿", "word " * 30_000, "x" * 50_000]
    words = packing.WordEncoder(path)
    for text, ids in zip(texts, words.encode(texts), strict=True):
        want = whole.encode(text or "", add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == want, text


def test_pack(spark, path):
    from tokenizers import Tokenizer

    rng = random.Random(7)
    rows = [(i, " ".join(rng.choices(["alpha", "beta,", "x"], k=rng.choice([0, 1, 3, 40, 90])))) for i in range(200)]
    rows += [(500, None), (501, ""), (7, rows[7][1]), (None, "alpha"), (502, "alpha beta " * 700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as piece", "2 as length")
    got = packing.pack(docs.repartition(3), path, capacity=256).collect()
    whole = Tokenizer.from_file(path)
    want = []
    for d, text in rows:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [1]
        for p, at in enumerate(range(0, len(ids), 256)):
            part = ids[at : at + 256]
            want.append((d, p, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 256
    assert len(sequences) <= 1.05 * sum(r[3] for r in want) / 256 + 1


def test_empty_table(spark, path):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0


def test_ranks_of_many_parts_and_lengths(spark):
    """Over a thousand lengths, one of them in a third of all rows, from many parts: every slot is taken once."""
    rows = spark.range(60_000).select(
        (F.col("id") % 37).cast("int").alias("part"),
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 1500 + 1).cast("long").alias("length"),
        F.col("id").alias("doc_id"),
    )
    own = Window.partitionBy("part", "length").orderBy("doc_id")
    items = rows.withColumn("rank", (F.row_number().over(own) - 1).cast("long")).cache()
    got = packing.pack_pieces(items).groupBy("sequence_id")
    got = got.agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"), F.countDistinct("offset").alias("d"), F.count("*").alias("c"))
    bad = got.where("n <> `end` or n > 4096 or d <> c")
    assert bad.count() == 0 and got.agg(F.sum("c")).first()[0] == 60_000

import random

import numpy as np
import pytest
import xxhash

from faircart.llm import simhash
from faircart.llm.components import connected_components


def brute(rows, tau=4):
    fps = [simhash.fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= tau:
                group[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, f"{f:016x}", least.get(root(i))) for i, ((d, _), f) in enumerate(zip(rows, fps))), key=str)


def test_fingerprint_by_hand():
    words = b"The QUICK brown fox jumps".lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(2)]
    assert simhash.fingerprint("The\tQUICK  brown\nfox jumps") == h[0] & h[1]
    assert simhash.fingerprint("É two") == xxhash.xxh64_intdigest("É two".encode(), 42)
    assert simhash.fingerprint("") == simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_matches_brute_force(spark):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for d in range(120):
        words = rng.choices(vocab, k=rng.choice([1, 3, 5, 60, 200]))
        rows.append((d, " ".join(words)))
        for c in range(rng.choice([0, 0, 1, 3])):
            copy = list(words)
            copy[rng.randrange(len(copy))] = "changed"
            rows.append((1000 + 10 * d + c, " ".join(copy)))
    rows += [(None, rows[0][1]), (7, rows[7][1]), (5000, None), (5001, ""), (5002, "long " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "'x' as component_id")
    got = sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize(("level", "block"), zip(simhash.LEVELS, [8192, 5, 5, 8192], strict=True))
def test_links_are_lossless(spark, level, block):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    fps = set(base.tolist())
    for x in base[:30].tolist():
        for _ in range(6):
            fps.add(x ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False)))
    fps = sorted(fps)
    want = {frozenset((a, b)) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 4}
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = {r.node: r.component for r in connected_components(simhash.links(df, level=level, block=block)).collect()}
    edges = spark.createDataFrame([tuple(map(signed, p)) for p in want], "src long, dst long")
    assert got == {r.node: r.component for r in connected_components(edges).collect()}


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 160)}}

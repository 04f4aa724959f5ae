import random
from collections import Counter

import numpy as np

from faircart.llm import substring


def brute(rows, window):
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, float("inf")), float("inf") if d is None else d)
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (float("inf") if d is None else d):
                gone.update(range(i, i + window))
        spans, at = [], 0
        for i in sorted(gone):
            if spans and spans[-1][1] == i:
                spans[-1][1] = i + 1
            else:
                spans.append([i, i + 1])
        out.append((d, len(w), len(gone), str(spans), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, str([[s.start, s.end] for s in r.spans]), r.kept) for r in df.collect()), key=str)


def data():
    rng = random.Random(3)
    vocab = ["a", "b", "é", "Ünd", "x" * 40, "1"] + [f"w{i}" for i in range(40)]
    passages = [rng.choices(vocab, k=rng.choice([5, 6, 9, 30])) for _ in range(12)]
    rows = []
    for d in rng.sample(range(-50, 400), 160):
        words = rng.choices(vocab, k=rng.choice([0, 3, 5, 40, 90]))
        for _ in range(rng.choice([0, 0, 1, 2])):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(passages)
        rows.append((d, "".join(w + rng.choice([" ", "\n", "\t\x0b "]) for w in words)))
    rows += rng.sample(rows, 10)  # repeated rows
    rows += [(5000, rng.choice(rows)[1] + f" {i}") for i in range(90)]  # one id with a third of all rows
    rows += [(None, rows[3][1]), (None, rows[3][1]), (None, "only here " * 4), (900, None), (901, ""), (902, " \n"), (903, "a b " * 12)]
    rows += [(904, "same " * 30_000), (905, "same " * 7)]
    return rows


def test_matches_brute_force(spark):
    rows = data()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as chunk", "2 as `a.b`", "'x' as kept").repartition(3)
    want = brute(rows, 5)
    assert got(substring.remove_repeats(docs, 5)) == want
    assert sum(r[2] for r in want) > 1000


def test_chunks_give_the_same(spark, monkeypatch):
    rows = data()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(substring, "GATHERED", 100)
    assert got(substring.remove_repeats(docs, 5, 4000)) == brute(rows, 5)


def test_a_hot_id_is_split(spark):
    docs = spark.createDataFrame([(7 if i % 2 else i, f"text number {i}") for i in range(400)], "doc_id long, text string")
    chunk, split, parts = substring.chunk_columns(docs, 500)
    rows = docs.select("doc_id", chunk.alias("c"), split.alias("s")).collect()
    assert parts > 5
    assert len({r.c for r in rows if r.doc_id == 7}) == 1
    assert {r.doc_id for r in rows if r.c in {x.c for x in rows if x.doc_id == 7}} == {7}
    assert max(Counter((r.c, r.s) for r in rows).values()) < 100


def test_empty_tables(spark):
    assert substring.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    none = spark.createDataFrame([(None, None)], "doc_id long, text string")
    assert got(substring.remove_repeats(none)) == [(None, 0, 0, "[]", "")]


def test_hashes_depend_on_words_alone():
    hashes = substring.Hashes(3)
    a = hashes.of(b"x y z x y z w")
    b = substring.Hashes(3).of(b" q\tx y\nz ")
    for k in range(2):
        assert a[k][0] == a[k][3] == b[k][1]
        assert len(set(a[k].tolist())) == 4


def test_keys_survive_packing():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**64 - 1, 1000, np.uint64, endpoint=True))
    assert (substring.unpack_keys(substring.pack_keys(keys)) == keys).all()


def test_later_tells_keys_by_both_parts():
    key = np.array([5, 5, 5, 9, 9, 1], np.uint64)
    check = np.array([1, 2, 1, 3, 3, 1], np.uint32)
    order = np.array([2, 0, 1, 4, 4, 0])
    assert substring.later(key, check, order).tolist() == [True, False, False, False, False, False]


def test_pieces_of_a_text_give_the_same(monkeypatch):
    text = " ".join(f"word{i % 7} é{i}" for i in range(300)).encode()
    whole = substring.Hashes(4).of(text)
    monkeypatch.setattr(substring, "PIECE", 10)
    parts = substring.Hashes(4).of(text)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))
    assert len(whole[0]) == 597
    assert len(substring.Hashes(4).of(b"x" * 1000)[0]) == len(substring.Hashes(4).of(None)[0]) == 0

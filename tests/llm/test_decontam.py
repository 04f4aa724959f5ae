import random

from faircart.llm import decontam


def brute(rows, items, width=5, threshold=0.8):
    out = []
    for d, text in rows:
        words = decontam.words_of(text)
        for i, item in items:
            want = decontam.words_of(item)
            if not want:
                continue
            n = min(width, len(want))
            parts = decontam.shingles_of(want, width)
            have = {" ".join(words[k : k + n]) for k in range(len(words) - n + 1)}
            if len(parts & have) >= threshold * len(parts) - 1e-9:
                out.append((d, i, len(parts & have), len(parts)))
    return sorted(out, key=str)


def data():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([1, 3, 5, 6, 17, 40, 70])))) for i in range(40)]
    items += [(100, ""), (101, None), (102, items[9][1]), (103, "... !")]
    rows = []
    for d in range(150):
        words = rng.choices(vocab, k=rng.choice([0, 2, 30, 400]))
        if d % 3 == 0:
            piece = (items[rng.randrange(40)][1]).split()
            for _ in range(rng.choice([0, 1, 2, 4])):
                piece[rng.randrange(len(piece))] = "changed"
            at = rng.randrange(len(words) + 1)
            words[at:at] = [w.upper() + rng.choice(["", ",", "!!"]) for w in piece]
        rows.append((d, " ".join(words)))
    return rows + [(3, rows[3][1]), (None, items[8][1]), (900, None), (901, ""), (902, "x " * 100_000)], items


def test_matches_brute_force(spark):
    rows, items = data()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as m", "2 as item_id")
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    got = decontam.contained_items(docs, bench)
    assert sorted((tuple(r)[:4] for r in got.collect()), key=str) == brute(rows, items)
    kept = decontam.decontaminate(docs.withColumnRenamed("m", "hit"), bench)
    assert kept.columns == ["doc_id", "text", "hit", "item_id"]
    hit = {r[0] for r in brute(rows, items)}
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((d for d, _ in rows if d not in hit), key=str)


def test_blocks_give_the_same(spark):
    rows, items = data()
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert len(list(decontam.item_blocks(bench, 500))) > 3
    got = decontam.contained_items(spark.createDataFrame(rows, "doc_id long, text string"), bench, chars=500)
    assert sorted((tuple(r)[:4] for r in got.collect()), key=str) == brute(rows, items)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    full = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert decontam.contained_items(docs, bench).count() == 0
    assert decontam.contained_items(full, bench).count() == 0
    assert decontam.decontaminate(full, bench).count() == 1

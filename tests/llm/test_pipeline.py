import random

import pytest

import corpus_pipeline
from faircart.llm import similar


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute(rows):
    """The smallest (doc_id, text) of each component of pairs at 0.8 or more."""
    sets, group = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                group[root(i)] = root(j)
    least = {}
    for i, (d, t) in enumerate(rows):
        mark = (d is None, d or 0, t is not None, t or "")
        least[root(i)] = min(mark, least.get(root(i), mark))
    return sorted(((None if a else d, t if b else None) for a, d, b, t in least.values()), key=str)


def near_copies(seed=5):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for d in range(60):
        words = rng.choices(vocab, k=rng.choice([1, 3, 5, 40, 60, 200]))
        rows.append((d, " ".join(words)))
        for c in range(rng.choice([0, 1, 3])):
            copy = list(words)
            for _ in range(max(1, len(words) // 60)):
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((1000 + 10 * d + c, " ".join(copy)))
    return rows


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as row_key", "'x' as class", "2 as text_", "3 as `a.b`")
    out = corpus_pipeline.drop_near_duplicates(spark, docs.repartition(3), None)
    assert out.columns == docs.columns
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)


def test_near_duplicates_match_brute_force(spark):
    rows = near_copies()
    rows += [(None, rows[0][1]), (5000, None), (5001, ""), (5002, "long " * 50_000)]
    want = brute(rows)
    assert kept(spark, rows) == want and len(want) < len(rows)


@pytest.mark.parametrize("block", [2048, 3])
def test_blocks_lose_no_pair(spark, block):
    rows = near_copies(6)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, known, _, _ = similar.classes(docs, block=block)
    assert known.select("component").distinct().count() == len(brute(rows))


ITEM = "one two three four five six seven eight nine ten eleven twelve"


def planted():
    """Documents and labels with each stage's cases, its nulls, repeats and very long texts among them."""
    rng = random.Random(8)
    vocab = [f"{a}{b}{c}{d}" for a in "bdfg" for b in "aeou" for c in "lmnr" for d in "aeo"]
    prose = lambda n: " ".join(rng.choices(vocab, k=n))
    rows, labels = [], []
    for d in range(600):
        text = prose(40)
        if d % 6 == 0:
            text += rng.choice([" zixqwy", " Zixqwy!", " zixqwy."])
        rows.append((d, text, "en", f"s{d % 3}", len(text)))
        labels.append((d, 1, int(d % 6 == 0)))
    add = lambda d, text: rows.append((d, text, None, None, None if text is None else len(text)))
    add(1000, rows[1][1]), add(1001, rows[2][1] + " tail"), add(None, rows[3][1]), add(1, rows[1][1])
    add(1002, f"{prose(30)} {ITEM.upper()} {prose(30)}"), add(1003, f"{prose(20)} mail jane@corp.example or +1 212 555 0100 {prose(20)}")
    add(1004, None), add(1005, ""), add(1006, "long " * 30_000), add(1007, f"{prose(40)} z.i.x.q.w.y")
    return rows, labels


def packed_rows(docs):
    """Pieces by doc_id as the packing stage must give them."""
    import struct
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    whole, out = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json"))), []
    for d, text in docs:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [1]
        for p, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            out.append((d, p, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    return sorted(out, key=str)


def test_stages_and_run(spark, tmp_path):
    rows, labels = planted()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs.selectExpr("*", "1 as row", "2 as row_key", "3 as `all`", "4 as `a.b`"), str(tmp_path)).drop("row", "row_key", "all", "a.b").cache()
        assert docs.columns == schema.replace(",", "").split()[::2]
        left[name] = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
    toxic = {d for d, _, t in labels if t} | {1007}
    kept = [r[:2] for r in rows if r[0] not in toxic]
    assert left["toxicity"] == sorted(kept, key=str)
    assert [d for d, _ in left["near_duplicates"]] == [d for d, _ in brute(left["toxicity"])]
    clean = [r for r in left["near_duplicates"] if r[0] != 1002]
    assert left["benchmark"] == clean and len(clean) < len(left["near_duplicates"])
    safe = dict(left["personal_data"])
    assert safe.keys() == dict(clean).keys() and "jane" not in safe[1003] and "[EMAIL]" in safe[1003] and "[PHONE]" in safe[1003]
    assert all(t == safe[d] for d, t in clean if d != 1003)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in docs.collect())
    want = packed_rows(left["personal_data"])
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == want
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        ends = [0, *(o + n for o, n in sorted(parts))]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 4096


def test_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

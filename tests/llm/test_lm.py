import random
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
import xxhash

from faircart.llm import lm


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w.encode() for w in re.findall("[^\x20\x09-\x0d]+", low)] + [lm.END]


def fold(d):
    return -1 if d is None else zlib.crc32(str(d).encode()) % 5


def brute(rows):
    c = Counter(t for d, text in rows if fold(d) != 1 for t in tokens(text))
    n, v = sum(c.values()), len(c)
    out = []
    for d, text in rows:
        ts = tokens(text)
        base = sum(log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)
        out.append((d, fold(d) == 1, len(ts), sum(c[t] > 0 for t in ts), n, base))
    return out


def key(r):
    return str(r[0]), r[2], r[5]


def check(got, want):
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * max(1, abs(b[5])), (a, b)


def test_base_by_brute_force(spark):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(3000)]
    rows = [(d, " ".join(rng.choices(vocab, weights=range(3000, 0, -1), k=rng.choice([0, 1, 20, 200])))) for d in range(300)]
    rows += [(900, None), (901, ""), (902, "\n\t A b\x0bC é É"), (903, "x" * 100_000), (None, "w1 w2 new"), (5, rows[5][1])]
    rows += [(904, "W1 " * 5_000 + "unheard")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "2 as c")
    for frequent in (lm.FREQUENT, 1500):
        got = lm.score(docs.repartition(3), frequent=frequent).collect()
        check([tuple(r)[:6] for r in got], brute(rows))
        assert all(np.isfinite(r.score) and r.score < 0 for r in got)


def lexicon():
    words = [(f"w{i}".encode(), 5000 - i) for i in range(1500)] + [(lm.END, 40)]
    return lm.Lexicon(sorted(words, key=lambda w: -w[1]), sum(c for _, c in words), len(words))


def test_gradient_by_differences():
    rng = np.random.default_rng(0)
    model = lm.GatedModel.start(lexicon())
    x, y = rng.integers(0, model.vocab + lm.TAILS + 1, (5, 3)), rng.integers(0, model.vocab + 1, (5, 3))
    y[0, 0], y[0, 1] = 3, model.vocab
    y[3:, 2] = -1
    h = rng.normal(size=(3, lm.HIDDEN)).astype(np.float32)
    _, grad, _ = model.gradient(x, y, h)
    direction = (grad.flat != 0) * rng.normal(size=len(grad.flat)).astype(np.float32)
    step = 1e-3
    loss = [-lm.GatedModel(model.flat + s * direction, model.side).gradient(x, y, h)[0] for s in (step, -step)]
    assert abs((loss[0] - loss[1]) / (2 * step) - float(grad.flat @ direction)) < 2e-2 * max(1, abs(float(grad.flat @ direction)))


def test_whole_sequences_and_normalisation():
    rng = np.random.default_rng(1)
    model = lm.GatedModel.start(lexicon())
    xs = [rng.integers(0, 1000, n) for n in (1, 150, 64, 65, 700)]
    ys = [rng.integers(0, model.vocab + 1, len(x)) for x in xs]
    want = []
    for x, y in zip(xs, ys):
        h, total = np.zeros((1, lm.HIDDEN), np.float32), 0.0
        for a, b in zip(x, y):
            h, _ = model.step(model.x[[a]], h)
            total += float(model.log_prob(h, np.array([b]))[0])
        want.append(total)
    assert np.allclose(model.score(xs, ys, group=2, window=64), want, rtol=1e-4)
    h = rng.normal(size=(1, lm.HIDDEN)).astype(np.float32).repeat(model.vocab + 1, 0)
    assert abs(np.exp(model.log_prob(h, np.arange(model.vocab + 1)).astype(np.float64)).sum() - 1) < 1e-4


def test_model_beats_the_base_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lm.score(docs).where("held_out").agg({"score": "sum", "base_score": "sum", "n_tokens": "sum"}).first()
    print(got)
    assert got["sum(score)"] > got["sum(base_score)"]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(docs).count() == 0
    held = [d for d in range(50) if fold(d) == 1][:2]
    got = lm.score(spark.createDataFrame([(d, "a b") for d in held], "doc_id long, text string")).collect()
    check([tuple(r)[:6] for r in got], brute([(d, "a b") for d in held]))


def test_training_reads_every_token(spark, monkeypatch, tmp_path):
    rows = [(d, " ".join(f"w{(d + i) % 50}" for i in range(n))) for d, n in enumerate([0, 1, 20, 31, 32, 33, 100, 700] * 3)]
    lex, log = spark.sparkContext.broadcast(lexicon()), str(tmp_path)

    class Told:
        tokens = 0

        def __init__(self, model):
            pass

        def fit(self, sequences):
            for _, y in sequences:
                with open(f"{log}/seen", "a") as f:
                    f.write(f"{len(y)}\n")

    monkeypatch.setattr(lm, "Trainer", Told)
    lm.train(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), lex)
    seen = sorted(int(n) for n in (tmp_path / "seen").read_text().split())
    assert seen == sorted(len(tokens(t)) for _, t in rows)


def test_fit_carries_state_over_all_windows():
    model = lm.GatedModel.start(lexicon())
    trainer, update, windows = lm.Trainer(model), lm.Trainer.update, []
    trainer.update = lambda x, y, h: windows.append((int((y >= 0).sum()), bool(h.any()))) or update(trainer, x, y, h)
    trainer.fit([(np.full(n, 3), np.full(n, 4)) for n in (100, 33, 1)])
    assert [n for n, _ in windows] == [32 + 32 + 1, 32 + 1, 32, 4] and [c for _, c in windows] == [False, True, True, True]


def test_words_of_a_column():
    texts = ["A b\x0bC é É\x1c a", None, "", " \n\t", "x" * 65 + " a " + "X" * 65, "one\x00two A", "end "]
    words, codes, sizes = lm.words_of(pa.array([t and t.encode() for t in ["cut off", *texts]], pa.binary()).slice(1))
    assert len(set(words)) == len(words)
    at, lowest = 0, lambda w: w if len(w) <= lm.WORD_BYTES else lm.END + xxhash.xxh128_digest(w)
    for text, size in zip(texts, sizes, strict=True):
        assert [words[i] for i in codes[at : at + size]] == [lowest(w) for w in tokens(text)[:-1]]
        at += size
    assert at == len(codes)


def test_states_of_a_window_are_those_of_steps():
    rng = np.random.default_rng(2)
    model = lm.GatedModel.start(lexicon())
    x, h = rng.integers(0, model.vocab, (9, 4)), rng.normal(size=(4, lm.HIDDEN)).astype(np.float32)
    kept = []
    states = model.states(x, h, kept)
    for t in range(9):
        h, parts = model.step(model.x[x[t]], h)
        assert np.allclose(states[t + 1].T, h, atol=1e-5)
        assert all(np.allclose(k[t].T, p, atol=1e-5) for k, p in zip(kept, parts, strict=True))


def test_ids_need_no_list_of_distinct_words():
    long = b"y" * (lm.WORD_BYTES + 1)
    lex = lm.Lexicon([(w, 9) for w in (b"a", lm.END + xxhash.xxh128_digest(long), b"b", lm.END)], 36, 9)
    texts = pa.array([b"A c b", None, long + b" " + b"z" * 100 + b" a", b"", long[:-1]], pa.binary())
    words, sizes = lm.cut(texts)
    assert sizes.tolist() == [3, 0, 3, 0, 1] and lex.ids_of(words).tolist() == [0, 4, 2, 1, 4, 0, 4]
    distinct, codes, _ = lm.words_of(texts)
    assert lex.ids(distinct)[codes].tolist() == lex.ids_of(words).tolist()
    assert lex.ids_of(lm.cut(pa.array([None, b" "], pa.binary()))[0]).tolist() == []

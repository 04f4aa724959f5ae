import random

import numpy as np

from faircart.llm import toxicity as tx


def features(w):
    code = tx.codes_of([w])[0]
    code = code[code > 0]
    out = {}
    for i in range(len(code)):
        for a, b, weight in tx.GAPS:
            if i + a + b < len(code):
                u = (code[i], code[i + a], code[i + a + b])
                out[u] = out.get(u, 0) + weight
    return out


def plain_kernel(s, t):
    """Triple loop over the definition."""
    f, g = features(s), features(t)
    size = lambda x: sum(v * v for v in x.values()) ** 0.5
    return sum(v * g.get(u, 0) for u, v in f.items()) / (size(f) * size(g)) if f and g else 0.0


def test_kernel_by_definition():
    words = ["idiot", "i.d.i.o.t", "idi0t", "réeuxment", "the", "a", "patio", "aaaaaaaa"]
    k = tx.Kernel(words).values(words)
    for i, s in enumerate(words):
        for j, t in enumerate(words):
            assert abs(k[i, j] - plain_kernel(s, t)) < 1e-5
    assert k[2, 0] > 0.3 > k[4, 0] and k[1, 0] > 2 * k[4, 0] and abs(k[7, 7] - 1) < 1e-5


def brute_rows(text, landmarks):
    """Kernel rows of all sentences that hold anything, by the definition of the sentence kernel."""
    tokens, out, at = (text or "").lower().split(), [], 0
    while at < len(tokens):
        end = at + 1
        while end < len(tokens) and tokens[end - 1][-1] not in ".!?" and end % tx.LONGEST:
            end += 1
        row = np.zeros(len(landmarks))
        for w in tokens[at:end]:
            for j, z in enumerate(landmarks):
                k = plain_kernel("".join(c for c in w if c.isalnum()) or w, z)
                row[j] += k**tx.POWER if k >= tx.FLOOR else 0
        if row.any():
            out.append(row)
        at = end
    return out


def test_sentence_rows_by_definition():
    rng, landmarks = random.Random(4), ["idiot", "clown", "theon"]
    vocab = "idiot idi0t i.d.iot! clown. clowns the on in. crown, patio? iidiot trash -".split()
    texts = [" ".join(rng.choices(vocab, k=n)) for n in (0, 1, 5, 60, 200)] + [None, "  ", "idiot. . ! idiot"]
    x, owner = tx.Sentences(tx.Kernel(landmarks))(texts)
    for i, t in enumerate(texts):
        own = sorted(map(tuple, np.round(x[owner == i], 4)))
        assert own == sorted([(0.0,) * 3] + [tuple(np.round(r.astype(np.float32), 4)) for r in brute_rows(t, landmarks)])


def test_machine_against_the_kernel_form():
    """With every sentence a landmark, the Nyström machine decides as the kernel machine on the full matrix does."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeiot", k=5)) for _ in range(30)] + ["idiot", "idioot", "idi0t", "idiots"]
    y = np.array([0] * 30 + [1] * 4)
    k = tx.Kernel(words).values(words).astype(np.float64) ** tx.POWER
    n = len(y)
    value, vector = np.linalg.eigh((k + k.T) / 2)
    assert value.min() > -1e-6  # a kernel
    x = np.c_[k @ (vector / np.sqrt(np.maximum(value, 1e-9)) @ vector.T), np.ones(n)]
    costs, all_texts = tx.machine_costs(np.array([[30, 4]])), np.ones((1, n), bool)
    w = tx.descend(lambda w: tx.hinge_sums(x, np.arange(n), y > 0, all_texts, w, x[:, :1], costs), np.zeros((1, n + 1)), 50)
    primal = x @ w[0]
    a, c, s = np.zeros(len(y)), 0.0, np.where(y > 0, 1.0, -1.0)
    cost = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    for _ in range(200):  # Newton on the representer weights of the same loss
        own = s * (k @ a + c) < 1
        d = np.diag(2 * cost * own)
        left = np.block([[d @ k + np.eye(len(y)), d.sum(1, keepdims=True)], [(2 * cost * own)[None] @ k, np.array([[(2 * cost * own).sum() + 1e-6]])]])
        a, c = np.split(np.linalg.solve(left, np.r_[2 * cost * own * s, (2 * cost * own * s).sum()]), [len(y)])
        c = float(c[0])
    assert np.allclose(primal, k @ a + c, atol=1e-2)


def auc(score, y):
    order = np.argsort(score)
    rank = np.empty(len(y))
    rank[order] = np.arange(len(y))
    n = y.sum()
    return (rank[y == 1].sum() - n * (n - 1) / 2) / (n * (len(y) - n))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = tx.score(docs, labels).join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    y, s, p = (np.array([r[c] for r in rows]) for c in ("toxic", "score", "predicted"))
    tp = ((p == 1) & (y == 1)).sum()
    precision, recall = tp / p.sum(), tp / y.sum()
    print(len(y), y.sum(), "auc", auc(s, y), "precision", precision, "recall", recall)
    # A small table: a language's insulting stems occur in a few dozen labelled texts at most.
    assert auc(s, y) > 0.93 and precision > 0.85 and recall > 0.6


def test_edge_rows(spark):
    rng = random.Random(1)
    filler = [f"{a}{b}{c}" for a in "bdfg" for b in "aeou" for c in "lmnr"]
    rows, labels = [], []
    for d in range(400):
        words = rng.choices(filler, k=30)
        if d % 4 == 0:
            words[rng.randrange(30)] = rng.choice(["zixqwy", "zixqwy!", "Zixqwy"])
        rows.append((d, " ".join(words)))
        labels.append((d, int(d % 4 == 0)))
    clean = rows[1][1]
    rows += [(900, None), (901, ""), (902, clean + " z.i.x.q.w.y"), (903, clean + " z i x q w y"), (904, "x" * 100_000)]
    rows += [(905, "zixqwy " * 20_000), (None, rows[0][1]), (0, rows[0][1]), (906, clean + "   ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "2 as toxic")
    known = spark.createDataFrame(labels + [(1, None), (None, 1), (5, 0)], "doc_id long, toxic int")
    got = tx.score(docs.repartition(3), known).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(by[d].predicted == t for d, t in labels)
    assert [by[d].predicted for d in (900, 901, 902, 903, 904, 905, 906, None)] == [0, 0, 1, 1, 0, 1, 0, 1]
    assert by[None].held_out is False
    kept = tx.reject_toxic(docs, known)
    assert kept.columns == docs.columns and 902 not in {r.doc_id for r in kept.collect()}


def test_no_labels_and_empty(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert {(r.score, r.predicted) for r in tx.score(docs, none).collect()} == {(0.0, 0)}
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")
    assert {r.score for r in tx.score(docs, one).collect()} == {1.0}
    assert tx.score(docs.limit(0), one).count() == 0


def test_sums_do_not_depend_on_dealing(spark):
    """All sentences count: the fit over one task and over several, with long and short texts, gives one machine."""
    rng, landmarks = random.Random(8), ["idiot", "clown", "theon", "patio"]
    vocab = "idiot idi0t clown. clowns the on in. crown, patio? iidiot trash".split()
    kernel, texts = tx.Kernel(landmarks), []
    for i in range(80):
        words = rng.choices(vocab[4:], k=rng.choice([1, 20, 400]))
        texts.append(" ".join(words + rng.choices(vocab[:4], k=3) * (i % 3 == 0)))
    read, rows = tx.Sentences(kernel), []
    for i, text in enumerate(texts):
        x, _ = read([text])
        rows.append((bytearray(tx.packed(x)), len(x), int(i % 3 == 0), i % 4))
    df = spark.createDataFrame(rows, "x binary, n long, toxic int, fold int")
    one, many = (tx.fit(df.repartition(k), kernel, 2) for k in (1, 7))
    assert np.allclose(one.weights, many.weights, atol=1e-6) and abs(one.bias - many.bias) < 1e-6
    assert one.weights[:2].min() > 0 and abs(one.a - many.a) < 1e-4
    assert sum(r[1] for r in rows) > 1000  # far more sentences than texts

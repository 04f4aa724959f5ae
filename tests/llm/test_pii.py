import hashlib
import random
import re
from collections import Counter
from math import log2

from faircart.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(n):
    total = 0
    for i, d in enumerate(map(int, reversed(n))):
        d = d * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(0, m) for m in EMAIL.finditer(text)]
    out += [(1, m) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, m) for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(3, m) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return [(k, m.start(), m.end(), m[0]) for k, m in out]


def groups(s):
    value = re.sub("[^0-9]", "", s[3]) if s[0] > 1 else s[3].lower()
    group = {0: value.split("@")[-1], 1: ".".join(value.split(".")[:2]), 2: value[:6], 3: value[:4]}[s[0]]
    return {(s[0], value), (s[0] + 10, group)}


def brute(rows):
    spans = [base(t or "") for _, t in rows]
    term = re.compile(r"[^\W\d_]{3,}")
    names = [set().union(*map(groups, ss)) for ss in spans]
    words = [set(term.findall((t or "").lower())) for _, t in rows]
    n_c, n_t = Counter(e for es in names for e in es), Counter(t for ts in words for t in ts)
    n_ct = Counter((e, t) for es, ts in zip(names, words) for e in es for t in ts)
    texts = {}
    for (_, text), es, ts in zip(rows, names, words):
        for e in es:
            for t in ts:
                texts.setdefault((e, t), set()).add(text)
    share, n = {}, len(rows)
    for (e, t), both in n_ct.items():
        if n > n_c[e]:
            m, k = len(texts[e, t]), min(n_c[e], n_t[t])
            share[e, t] = log2(n * both / (n_c[e] * n_t[t])) / log2(n / n_c[e]) * m / (m + 1) * k / (k + 1)
    out = []
    for (d, text), ss, es in zip(rows, spans, names):
        more = []
        for m in term.finditer(text or ""):
            if any(share.get((e, m[0].lower()), 0) >= pii.GENERALISE for e in es) and not any(x[1] < m.end() and m.start() < x[2] for x in ss):
                more.append((4, m.start(), m.end()))
        text = lambda xs: ",".join(f"{pii.KINDS[x[0]]}:{x[1]}:{x[2]}" for x in xs)
        counts = [sum(s[0] == k for s in ss) for k in range(4)] + [len(more)]
        out.append((d, *counts, hashlib.sha256(text(ss).encode()).hexdigest(), text(ss + more)))
    return out


CASES = [
    "a@b.c_d@e.f a@b..c x@@y@z.w %+-@a-.-b. abc@def@g.h.i a@b.c..x@y.z é@x.y 😀q@w.e",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0004 1.2.3 12.34.56.78.9 0255.255.255.255 99999999999.1.1.1",
    "4111111111111111 4111 1111 1111 1111 4111-1111-1111-1111 41111111111111112 4111  1111 1 2 3 4 5 6 7 8 9 0 1 2 3",
    "+1 (017) 555-7713 +12 +1234567890123456 +44 20 7946 0958. ++1-212-555-0100 +1 2 + 3 +1(5)",
    "4" * 30_000 + " " + "a" * 30_000 + "@",
    "a.b" * 5_000 + "@" + "c.d" * 5_000,
    "1 " * 20_000 + "+" + "1 " * 20_000,
]


def rows():
    rng = random.Random(9)
    letters = "abcd1234@.+-% ()\n5é"
    out = [(i, c) for i, c in enumerate(CASES)]
    out += [(100 + i, "".join(rng.choices(letters, k=rng.choice([5, 60, 300])))) for i in range(300)]
    for i in range(40):
        filler = " ".join("w" + "".join(rng.choices("abcdefgh", k=2)) for _ in range(12))
        out.append((1000 + i, f"{filler} the Quillfeather {'jane@corp.example' if i % 4 else '+1 212 555 0100'} estate of the {filler}"))
        out.append((2000 + i, f"{filler} the words"))
    return out + [(1, None), (2, ""), (None, CASES[0]), (0, CASES[0]), (1001, out[-1][1])]


def test_matches_brute_force(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string").selectExpr("*", "1 as key", "2 as spans")
    got = sorted((tuple(r) for r in pii.find(docs.repartition(3)).collect()), key=str)
    want = sorted(brute(rows()), key=str)
    for a, b in zip(got, want, strict=True):
        assert a == b
    assert sum(r[5] for r in want) > 20


def test_sanitise(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string").selectExpr("*", "1 as key", "2 as size", "3 as `all`", "4 as `row`", "5 as spans")
    got = pii.sanitise(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    text = {r.doc_id: r.text for r in got.collect()}
    assert text[1] is None and text[2] == ""
    assert "jane@" not in text[1002] and "[EMAIL]" in text[1002] and "Quillfeather" not in text[1002]
    assert text[2000].endswith("the words")
    assert all(not base(t or "") for d, t in text.items() if d and d >= 1000)


def test_empty_and_native(spark):
    got = pii.find(spark.createDataFrame([], "doc_id long, text string"))
    assert got.count() == 0
    assert "Python" not in got._jdf.queryExecution().toString()

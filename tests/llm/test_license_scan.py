import random
import re
from math import log

from faircart.llm import license_scan as ls

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows):
    all_words = [words_of(t) for _, t in rows]
    vocab = {w for _, text, _ in ls.TEMPLATES for w in text.split()}
    df = {w: sum(w in set(ws) for ws in all_words) for w in vocab}
    idf = {w: log((len(rows) + 1) / (c + 0.5)) for w, c in df.items()}

    def places(ws, phrase):
        p = phrase.split()
        return [i for i in range(len(ws) - len(p) + 1) if ws[i : i + len(p)] == p]

    out = []
    for (d, _), ws in zip(rows, all_words):
        base = [(i, label) for phrase, label in ls.PHRASES for i in places(ws, phrase)]
        labels, score = {x for _, x in base}, 0.0
        for label, text, keys in ls.TEMPLATES:
            if not all(places(ws, k) for k in keys):
                continue
            t = text.split()
            rare = sorted(set(t), key=lambda w: (-idf[w], w))[: ls.RARE]
            offsets = {}
            for i, w in enumerate(ws):
                if w in rare:
                    for j, x in enumerate(t):
                        if x == w:
                            offsets.setdefault(i - j, set()).add(w)
            share = max((sum(idf[w] for w in s) for s in offsets.values()), default=0) / sum(idf[w] for w in rare)
            share = min(1.0, round(share, 9))
            score = max(score, share)
            if share >= ls.COVER:
                labels.add(label)
        at = [i for i, _ in base]
        b = ",".join(sorted({x for _, x in base}))
        out.append((d, len(ws), len(at), min(at, default=None), max(at, default=None), b, ",".join(sorted(labels)), 1.0 if at else score))
    return out


def key(r):
    return str(r[0]), str(r[1:3])


def test_matches_brute_force(spark):
    rng = random.Random(3)
    vocab = "the of and under license version 2 this is work alpha beta gamma delta all rights".split()
    rows = []
    for d in range(300):
        words = rng.choices(vocab, k=rng.choice([0, 3, 40, 200]))
        if rng.random() < 0.5:
            notice = rng.choice(ls.TEMPLATES)[1].split()
            if rng.random() < 0.3:
                notice[rng.randrange(len(notice))] = "changed"
            at = rng.randrange(len(words) + 1)
            words[at:at] = notice
        rows.append((d, "".join(rng.choice([w, w.upper(), w.title()]) + rng.choice([" ", ", ", "\n", ".-"]) for w in words)))
    rows += [(900, None), (901, ""), (902, "..."), (903, "cc by nc cc by nc"), (904, "xcc by nc"), (905, "é cc BY-NC, É")]
    rows += [(906, "MIT License " * 3_000), (907, "license " * 20_000 + "Released under the MIT License."), (None, "all rights reserved")]
    rows += [rows[1], rows[1], (1, "other text under the mit license")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "2 as score", "'x' as norm")
    got = sorted((tuple(r) for r in ls.scan(docs.repartition(3)).collect()), key=key)
    for a, b in zip(got, sorted(brute(rows), key=key), strict=True):
        assert a[:7] == b[:7] and abs(a[7] - b[7]) < 2e-9, (a, b)


def test_empty_table_and_plan(spark):
    got = ls.scan(spark.createDataFrame([], "doc_id long, text string"))
    assert got.count() == 0
    assert "Python" not in got._jdf.queryExecution().toString()

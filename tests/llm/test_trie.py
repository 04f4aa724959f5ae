import hashlib
import random
import zlib

from faircart.llm import trie

KIND = "conv_id long, turn long, role string, text string"


def sequences(rows):
    turns = {}
    for c, n, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((n is not None, n or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in turns.items()}
    out = {}
    for c in own:
        k = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:k] + own[c][k:]
    return out


def brute(seqs):
    nodes = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append(c)
    children = {}
    for k in nodes:
        if k:
            children.setdefault(k[:-1], []).append(k)
    total = {}
    for k in sorted(nodes, key=len, reverse=True):
        below = [total[x] for x in children.get(k, [])]
        saved = (len(nodes[k]) - 1) * (len(k[-1][1].encode()) if k else 0)
        total[k] = (sum(b[0] for b in below) or 1, saved + sum(b[1] for b in below))
    out = []
    for k, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(seqs[c]) == len(k))))
        up = min(nodes[k[:-1]]) if k else None
        out.append((min(members), len(k), up, len(members), len(children.get(k, [])), *total[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def data():
    rng = random.Random(2)
    texts = ["hi", "Grüße", "", None, "a long reply", "no"]
    rows = []
    for c in rng.sample(range(600), 200):
        numbers = [None, *range(9)] if c % 7 == 0 else list(range(rng.choice([1, 2, 4, 9])))
        rows += [(c, n, rng.choice(["user", None]), rng.choice(texts)) for n in numbers]
    for c in range(1000, 1200):  # copies of one conversation
        rows += [(c, n, "user", f"copy {n}") for n in range(6)]
    rows += [(2000, n, "user", "copy 0") for n in range(3000)]
    rows += [(2003, 0, "user", "one turn"), (None, 1, "user", "nobody's"), (2011, 5, "user", "again"), (2011, 5, "user", "again")]
    rng.shuffle(rows)
    return rows


def none_first(rows):
    return sorted(rows, key=lambda r: (r[0], r[1]))


def test_matches_brute_force_whatever_bursts(spark, monkeypatch):
    rows = data()
    want = none_first(brute(sequences(rows)))
    monkeypatch.setattr(trie, "PIECE", 7)
    for capacity in (3, 40, 10_000):
        turns = spark.createDataFrame(rows, KIND).selectExpr("*", "1 as conv", "2 as `a.b`", "3 as ids").repartition(4)
        got = trie.prefix_nodes(trie.rebuilt(trie.turn_lists(turns)), capacity).collect()
        assert none_first(tuple(r) for r in got) == want


def test_turnless_and_empty(spark):
    # Without its base, a conversation with as many turns as are replaced has none left.
    c = next(c for c in range(1, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 1)
    one = trie.prefix_nodes(trie.rebuilt(trie.turn_lists(spark.createDataFrame([(c, 0, "user", "x")], KIND))))
    assert [tuple(r) for r in one.collect()] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    assert trie.prefix_nodes(trie.rebuilt(trie.turn_lists(spark.createDataFrame([], KIND)))).count() == 0

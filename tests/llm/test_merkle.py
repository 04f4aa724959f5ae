import hashlib
import random

from pyspark.sql import functions as F

from faircart.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
KIND = "doc_id long, text string, lang string, source string, n_chars long"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(hashes, fan):
    """``(root, path of each leaf)`` by the rule."""
    levels, paths = [list(hashes)], [[] for _ in hashes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        for i, p in enumerate(paths):
            at = i // fan ** (len(levels) - 1)
            run = at // fan * fan
            p.append(("".join(now[run:at]), "".join(now[at + 1 : run + fan])))
        levels.append([h("".join(now[i : i + fan])) for i in range(0, len(now), fan)])
    return levels[-1][0], paths


def brute(rows, fan):
    groups = {}
    for doc_id, text, lang, source, n in rows:
        groups.setdefault(source, []).append((doc_id, leaf((doc_id, source, lang, n, text))))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        groups[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees.append(tree([x[1] for x in groups[s]], fan))
    root, high = tree([t[0] for t in trees], fan)
    out = []
    for s, (sub, paths), up in zip(order, trees, high):
        out += [(d, s, x, sub, root, str(p + up)) for (d, x), p in zip(groups[s], paths)]
    return sorted(out, key=str)


def data():
    rng = random.Random(1)
    rows = [(i, f"Text {i} É", rng.choice(["en", "de", None]), f"s{rng.randrange(9)}", i) for i in rng.sample(range(900), 150)]
    rows += [(1000 + i, "hot", "en", "hot", 3) for i in range(130)]
    rows += [(7, "lone", "en", "zz", None), (None, None, None, None, None), (None, "", "", "", 0), (3, "x " * 100_000, "en", None, 2)]
    return rows + rows[:5] + [(1001, "other", "en", "hot", 3)]


def found(df):
    return sorted(((r.doc_id, r.source, r.leaf, r.subroot, r.root, str([(x.left, x.right) for x in r.path])) for r in df.collect()), key=str)


def test_matches_brute_force(spark):
    rows = data()
    docs = spark.createDataFrame(rows, KIND).selectExpr("*", "1 as rank", "2 as `a.b`", "3 as leaf", "4 as load").repartition(5)
    for fan in (2, 16):
        assert found(merkle.manifest(docs, FIELDS, F.lit(None), fan=fan)) == brute(rows, fan)


def test_proofs_fold_to_the_root_and_tampering_shows(spark):
    docs = spark.createDataFrame(data(), KIND)
    bad = merkle.digest([F.concat("text", F.lit("!")) if f == "text" else F.col(f) for f in FIELDS])
    got = merkle.manifest(docs, FIELDS, bad)
    got = got.select("leaf", "load", "root", merkle.fold(F.col("leaf"), F.col("path")).alias("same"), merkle.fold(F.col("load"), F.col("path")).alias("other"), merkle.proof_digest(F.col("path")).alias("p"), "path").collect()
    for r in got:
        assert r.same == r.root
        assert (r.load == r.leaf) == (r.other == r.root)
        assert r.p == h("".join(x.left + x.right for x in r.path))
    assert any(r.load != r.leaf for r in got)


def test_levels_carry_intervals(spark):
    rows = [("a", i, 40, f"h{i:02}", None) for i in range(40)] + [("b", 0, 1, "x", None)]
    levels, tops = merkle.ascend(spark.createDataFrame(rows, "g string, rank long, n long, digest string, load string"), 4)
    low = [tuple(r) for r in levels[0].select("rank", "lo", "hi").orderBy("rank").collect()]
    assert low == [(i, 4 * i, 4 * i + 4) for i in range(10)]
    assert [tuple(r) for r in levels[1].select("lo", "hi").orderBy("lo").collect()] == [(0, 16), (16, 32), (32, 40)]
    assert {r.g: r.digest for r in tops.collect()}["b"] == "x"


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], KIND)
    assert merkle.manifest(empty, FIELDS, F.lit(None)).count() == 0
    one = [(1, "a", "en", "s", 1)]
    assert found(merkle.manifest(spark.createDataFrame(one, KIND), FIELDS, F.lit(None))) == brute(one, 16)

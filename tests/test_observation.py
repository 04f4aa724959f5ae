"""Views of pages against walks over small random trees."""

import random

import pytest

from faircart.operators import observation

KIND = "page_id long, node int, path array<int>, tag string, role string, text string, label string, interactive boolean, x double, y double, w double, h double"
TEXTS = [None, "", "$3.99", "12 oz", "Add to cart", "a short text", "x", "¢", "5 ¢"]


def page(rng, page_id, size):
    rows = []
    for i in range(size):
        up = rows[rng.randrange(len(rows))] if rows else None
        path = [*(up[2] if up else []), i]
        box = [float(rng.randrange(0, 600, 50)) for _ in range(2)] + [float(rng.choice([40, 90, 100, 110, 300])) for _ in range(2)]
        tag, role = rng.choice(["div", "li", "a", "img", "h2", "article"]), rng.choice([None, None, "listitem", "x"])
        rows.append((page_id, i, path, tag, role, rng.choice(TEXTS), rng.choice([None, None, "label 3 ct"]), rng.random() < 0.3, *box))
    return rows


def scored(r):
    content = " ".join(t for t in (r[5], r[6]) if t).strip()
    s = 100 * ("$3" in content or "5 ¢" in content) + 80 * any(x in content for x in ("12 oz", "3 ct"))
    s += 35 * (r[3] in ("h2", "img")) + 30 * (r[3] == "a" and content != "") + 25 * (r[7] and "Add" in content)
    return s + 10 * (4 <= len(content) <= 240)


def pruned(rows, budget, required, subtrees):
    if len(rows) <= budget:
        return {r[1] for r in rows}
    kept, by = {0}, {r[1]: r for r in rows}
    for n in required:
        kept |= set(by[n][2]) if n in by else set()
    for t in subtrees:
        if t in by:
            kept |= set(by[t][2]) | {r[1] for r in rows if t in r[2]}
    for r in sorted((r for r in rows if scored(r) > 0), key=lambda r: (-scored(r), r[1])):
        if len(kept) >= budget:
            break
        more = set(r[2]) - kept
        if len(kept) + len(more) <= budget:
            kept |= more
    for r in rows:
        if len(kept) >= budget:
            break
        if r[1] not in kept and r[2][-2] in kept:
            kept.add(r[1])
    return kept


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(4)
    return {p: page(rng, p, rng.choice([1, 5, 12, 40, 90])) for p in range(30)}


def frame(spark, pages):
    return spark.createDataFrame([r for p in pages.values() for r in p], KIND)


def test_prune(spark, pages):
    rng = random.Random(5)
    required = {p: [rng.randrange(100), rng.randrange(5)] for p in pages if p % 3 == 0}
    ask = spark.createDataFrame([(p, n) for p, ns in required.items() for n in ns], "page_id long, node int")
    for budget in (1, 8, 30):
        for given in (None, ask.where("node < 5")):
            got = observation.prune(frame(spark, pages), budget, required=ask, subtrees=given).select("page_id", "node", "cut").collect()
            for p, rows in pages.items():
                need = required.get(p, [])
                want = pruned(rows, budget, need, need if given is None else [n for n in need if n < 5])
                assert {r.node for r in got if r.page_id == p} == want, (p, budget)
                assert all(r.cut == (len(want) < len(rows)) for r in got if r.page_id == p)


def test_pruned_views_are_closed_under_parents(spark, pages):
    got = observation.prune(frame(spark, pages), 10).collect()
    there = {(r.page_id, r.node) for r in got}
    assert all((r.page_id, up) in there for r in got for up in r.path)


def test_crop(spark, pages):
    regions = [(p, v, 100.0 * v, 50.0, 120.0, 200.0) for p in pages if p % 4 for v in (0, 3)]
    got = observation.crop(frame(spark, pages), spark.createDataFrame(regions, "page_id long, view int, x double, y double, w double, h double"))
    want = set()
    for p, v, x, y, w, h in regions:
        for r in pages[p]:
            if r[8] < x + w and r[8] + r[10] > x and r[9] < y + h and r[9] + r[11] > y:
                want |= {(p, v, n) for n in r[2]}
    assert sorted((r.page_id, r.view, r.node) for r in got.collect()) == sorted(want)


def test_complete_siblings(spark, pages):
    rng = random.Random(6)
    scores = {(p, r[1]): rng.choice([0.1, 0.29, 0.3, 0.5, 0.7, 0.95]) for p, rows in pages.items() for r in rows if rng.random() < 0.8}
    given = spark.createDataFrame([(*k, s) for k, s in scores.items()], "page_id long, node int, score double")
    regions = spark.createDataFrame([(p, 0.0, 0.0, 500.0, 900.0) for p in pages], "page_id long, x double, y double, w double, h double")
    want = set()
    for p, rows in pages.items():
        evidence = {n for r in rows if (r[5] or "").strip() or (r[6] or "").strip() for n in r[2]}
        known = [r for r in rows if (p, r[1]) in scores and r[1] in evidence and 0 <= r[8] + r[10] / 2 <= 500]
        sure = [r for r in known if scores[p, r[1]] >= 0.7]
        want |= {(p, r[1]) for r in sure}
        for up in {tuple(r[2][:-1]) for r in sure if len(r[2]) > 1}:
            anchors = [r for r in sure if tuple(r[2][:-1]) == up]
            if len(anchors) >= 2:
                a = min(anchors, key=lambda r: r[1])
                near = lambda r, k: min(r[k], a[k]) / max(r[k], a[k])
                want |= {(p, r[1]) for r in known if tuple(r[2][:-1]) == up and r[3] == a[3] and near(r, 10) >= 0.8 and near(r, 11) >= 0.7 and scores[p, r[1]] >= 0.3}
    got = observation.complete_siblings(frame(spark, pages), given, regions, 0.7).collect()
    assert {(r.page_id, r.node) for r in got} == want
    assert any(not r.anchored for r in got)


def test_card_roots(spark, pages):
    rng = random.Random(7)
    cited = {(p, r[1]) for p, rows in pages.items() for r in rows if rng.random() < 0.15}
    regions = spark.createDataFrame([(p, 0.0, 0.0, 500.0, 500.0) for p in pages], "page_id long, x double, y double, w double, h double")
    want = []
    for p, rows in pages.items():
        fit = {r[1] for r in rows if 0 <= r[9] + r[11] / 2 < 500 and 80 <= r[10] <= 325 and 100 <= r[11] <= 750}
        mine = [n for q, n in cited if q == p]
        for n in mine:
            chain = [i for i in reversed(rows[n][2]) if i in fit]
            named = [i for i in chain if rows[i][4] == "listitem" or rows[i][3] in ("li", "article")]
            alone = [i for i in chain if sum(i in rows[m][2] for m in mine) == 1]

            def order(i, rows=rows, fit=fit):
                a = rows[i]
                near = lambda r, k: min(r[k], a[k]) / max(r[k], a[k])
                peers = sum(j != i and rows[j][3:5] == a[3:5] and near(rows[j], 10) >= 0.8 and near(rows[j], 11) >= 0.7 for j in fit)
                return -peers, -a[10] * a[11], i

            if named or alone:
                want.append((p, n, named[0] if named else min(alone, key=order)))
    got = observation.card_roots(frame(spark, pages), spark.createDataFrame(sorted(cited), "page_id long, node int"), regions)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_prompts_come_back_as_they_went(spark, pages):
    views = spark.createDataFrame([(p, 0, 0.0, 0.0, 900.0, 900.0) for p in pages], "page_id long, view int, x double, y double, w double, h double")
    nodes = frame(spark, pages)
    asked = observation.prompts(observation.crop(nodes, views), views, "discover-products", "Name cards.")
    back = observation.parse_prompts(asked, ["page_id", "view"]).drop("view")
    assert sorted(map(str, back.collect())) == sorted(map(str, nodes.select(*back.columns).collect()))
    broken = spark.createDataFrame([(1, "nothing"), (2, "OBSERVATION: {oops"), (3, None)], "page_id long, prompt string")
    assert observation.parse_prompts(broken, ["page_id"]).count() == 0


def test_regions(spark):
    one = spark.createDataFrame([(1, 5.5, 10.0, 300.0, 700.0)], "page_id long, x double, y double, w double, h double")
    bands = observation.discovery_regions(one, 100.0).orderBy("view").collect()  # 320 at least
    assert [(r.view, r.y, r.h) for r in bands] == [(0, 10.0, 320.0), (1, 330.0, 320.0), (2, 650.0, 60.0)]
    nodes = spark.createDataFrame([(1, 0, [0], "div", None, None, None, False, 10.2, 600.0, 500.0, 200.0)], KIND)
    view = observation.extraction_regions(nodes, nodes, one)
    r = view.first()
    assert (r.view, r.x, r.y, r.w, r.h) == (0, 5.5, 576.0, 300.0, 134.0)
    c = observation.relative_crop(view, one).first()
    assert (c.left, c.top, c.width, c.height) == (0, 566, 300, 134)


def test_markup_titles(spark):
    text = "<img_alt= Red Bolt > <img_alt=one> <img_alt=Red Bolt> ximg_alt=no no> img_alt=two  words>"
    got = spark.createDataFrame([(text,)], "t string").select(observation.markup_titles("t").alias("m")).first().m
    assert got == ["Red Bolt", "two  words"]

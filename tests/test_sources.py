"""Files, generated relations, embedded products and streams, through real files."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from faircart.operators import selection, sets, tree, validate
from faircart.sources import files, generate, html
from faircart.streaming import sessions


def test_lines_documents_and_ledger(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "t": "x"}\n\n{"id": 2}\r\n')
    assert [(r.id, r.t) for r in files.read_lines(spark, str(tmp_path / "a.jsonl"), "id long, t string").collect()] == [(1, "x"), (2, None)]
    (tmp_path / "bad.jsonl").write_text('{"id": 1}\nnot json\n')
    got = files.read_lines(spark, str(tmp_path / "bad.jsonl"), "id long", strict=False).collect()
    assert sorted((r.id, r._corrupt) for r in got if r.id) == [(1, None)] and any(r._corrupt == "not json" for r in got)
    for name, text in (("p/1", '{\n"id": 7}'), ("p/2", "{broken")):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "page.json").write_text(text)
    rows = files.read_documents(spark, str(tmp_path / "p"), "id long").cache().collect()
    assert {(r.folder[-1], r.id, r._corrupt is None) for r in rows} == {("1", 7, True), ("2", None, False)}
    (tmp_path / "l.tsv").write_text("run\tcost\nr1\t3\n")
    assert [tuple(r) for r in files.read_ledger(spark, str(tmp_path / "l.tsv"), ["run", "cost"]).collect()] == [("r1", "3")]
    with pytest.raises(ValueError):
        files.read_ledger(spark, str(tmp_path / "l.tsv"), ["run", "price"])


def test_replay_and_training_set(spark, tmp_path):
    for i, blocked in enumerate((False, True)):
        folder = tmp_path / "pages" / str(i)
        folder.mkdir(parents=True)
        (folder / "main.html").write_text("<p>hi")
        (folder / "page.json").write_text(json.dumps({"blocked": blocked}))
    assert [r.folder[-1] for r in files.replay_pages(spark, str(tmp_path / "pages")).collect()] == ["0"]
    records = spark.createDataFrame([(1, "a", "train"), (2, "b", "train"), (3, "c", "validation")], "id long, t string, split string")
    first = files.write_training_set(records, str(tmp_path / "set"))
    again = files.write_training_set(records.orderBy(F.desc("id")).repartition(2), str(tmp_path / "set2"))
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect()))
    assert {r.split: r.records for r in first.collect()} == {"train": 2, "validation": 1}


def test_provenance_and_changes(spark):
    rows = spark.createDataFrame([("p", "b", "22"), ("p", "a", "1")], "page string, file string, body string")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sha(f"a\0{1}\0{sha('1')}\nb\0{2}\0{sha('22')}\n")
    assert [tuple(r) for r in files.provenance(rows, ["page"], "file", "body").collect()] == [("p", 2, 3, want)]
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", "3")], "k string, d string")
    b = spark.createDataFrame([("x", "1"), ("y", "5"), ("w", "3")], "k string, d string")
    assert sorted(map(tuple, files.changed_files(a, b, "k", "d").collect())) == [("w", "added"), ("y", "changed"), ("z", "removed")]


def test_targets_and_generator(spark):
    sites = spark.createDataFrame([("A shop", "a.org", "https://www.a.org/s?q={query}", ["x y", "X-Y"]), ("B", "b.org", "https://c.org/{querySlug}", ["z"])], "site string, host string, url string, queries array<string>")
    pages, faults = generate.expand_targets(sites)
    assert sorted(r.url for r in pages.collect()) == ["https://c.org/z", "https://www.a.org/s?q=X-Y", "https://www.a.org/s?q=x%20y"]
    assert sorted(map(tuple, faults.collect())) == [("a-shop--x-y", "duplicate-page"), ("b--z", "other-host")]
    one, two = generate.synthetic_products(spark, 100), generate.synthetic_products(spark, 100).repartition(3)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_nodes_of_odd_pages(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "<div><p>a<p>b &amp; c</div></section><img alt='pic'>"), (4, "<script>x<y</script><b>jane@corp.example</b>")], "page_id long, html string")
    got = [(r.page_id, r.tag, r.text, r.label, list(r.path)) for r in html.page_nodes(pages).orderBy("page_id", "node").collect()]
    assert got == [
        (3, "div", None, None, [0]), (3, "p", "a", None, [0, 1]), (3, "p", "b & c", None, [0, 1, 2]), (3, "img", None, "pic", [3]),
        (4, "script", None, None, [0]), (4, "b", "[REDACTED EMAIL]", None, [1]),
    ]


def test_greedy_cards_by_brute_force(spark):
    pages = spark.createDataFrame([(1, "<div><ul><li><a>x</a></li><li>yy</li></ul><p>z</p></div>")], "page_id long, html string")
    nodes = html.page_nodes(pages)
    scored = nodes.select("page_id", "node", F.when(F.col("tag") == "ul", 5).when(F.col("tag") == "a", 5).otherwise(1).alias("score"), F.length(F.coalesce("text", F.lit("aaaa"))).alias("length"))
    kept = {r.node for r in tree.greedy_cards(nodes, scored).collect()}
    path = {r.node: list(r.path) for r in nodes.collect()}
    assert kept and all(a == b or (a not in path[b] and b not in path[a]) for a in kept for b in kept)
    rank = sorted(scored.collect(), key=lambda r: (-r.score, r.length, r.node))
    want = []
    for r in rank:
        if all(w not in path[r.node] and r.node not in path[w] for w in want):
            want.append(r.node)
    assert kept == set(want)


def test_box_matching_by_brute_force(spark):
    import random

    rng = random.Random(1)
    rows = [(p, i, j, rng.choice([0.1, 0.5, 0.5, 0.9])) for p in range(5) for i in range(6) for j in range(6) if rng.random() < 0.6]
    got = validate.match_boxes(spark.createDataFrame(rows, "page long, predicted long, target long, iou double"), "page")
    want = []
    for p in range(5):
        left, right = set(), set()
        for _, i, j, _ in sorted((r for r in rows if r[0] == p), key=lambda r: (-r[3], r[1], r[2])):
            if i not in left and j not in right:
                left.add(i)
                right.add(j)
                want.append((p, i, j))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_retire_twice_changes_nothing(spark):
    active, retired = spark.createDataFrame([(1, "a"), (2, "b")], "id long, h string"), spark.createDataFrame([(3, "c")], "id long, h string")
    gone = spark.createDataFrame([(2, "b"), (1, "x")], "id long, h string")
    stay, old = sets.retire(active, retired, gone, ["id", "h"])
    again, older = sets.retire(stay, old, gone, ["id", "h"])
    assert [tuple(r) for r in again.collect()] == [(1, "a")] and sorted(map(tuple, older.collect())) == [(2, "b"), (3, "c")]


def test_batches_are_even_for_odd_keys(spark):
    rows = spark.createDataFrame([(i // 3 * 7,) for i in range(100)] + [(None,)], "k long")
    got = {r.k: r.batch for r in selection.batches(rows, "k", 5).collect()}
    assert got == {k: i // 5 + 1 for i, k in enumerate(sorted({i // 3 * 7 for i in range(100)}))}


def test_streams_agree_with_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    source = str(tmp_path / "in")
    events.repartition(3).write.parquet(source)
    late = spark.createDataFrame([(10**9, "2030-01-01 00:00:00", 1, "end")], "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    late.write.mode("append").parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    q = sessions.debounced(stream, "user_id", gap="30 minutes").writeStream.format("memory").queryName("debounced").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {tuple(r) for r in sessions.debounced(events, "user_id", gap="30 minutes").collect()}
    assert {tuple(r) for r in spark.table("debounced").collect()} == want and want
    path = str(tmp_path / "latest")
    one = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(source)
    one.writeStream.foreachBatch(sessions.keep_latest(path, ["user_id"], "ts", "event_id")).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    last = max(int(p.name) for p in (tmp_path / "latest").iterdir())
    from faircart.operators.compare import latest

    whole = latest(events.unionByName(late), ["user_id"], "ts", "event_id")
    assert {tuple(r) for r in spark.read.parquet(f"{path}/{last}").collect()} == {tuple(r) for r in whole.collect()}

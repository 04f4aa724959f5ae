"""Pages of any size are read whole."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from faircart.operators import tree
from faircart.plans import catalogue
from faircart.sources import html


def page_of(items, tail=""):
    links = "".join(f'<li><a href="/{i}">item {i}</a></li>' for i in range(items))
    return f"<html><body><nav><ul>{links}</ul></nav>{tail}</body></html>"


@pytest.fixture(scope="module")
def large(tmp_path_factory):
    """A page of more than 20,000 nodes, one of more than 160 cards, a small one and one without cards."""
    folder = tmp_path_factory.mktemp("pages")
    pages = [page_of(10_500), page_of(170), page_of(3, "<p>end"), "<p>none"]
    pq.write_table(pa.table({"page_id": pa.array(range(4), pa.int64()), "url": ["u"] * 4, "html": pages}), folder / "pages.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ("greedy_cards", "subtree_text"))
def test_large_pages_agree_with_sql(spark, large, name):
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW pages AS SELECT * FROM '{large}/pages.parquet'")
        want = con.sql(catalogue.ORACLE_SQL[name]).fetchall()
    assert sorted(map(tuple, catalogue.QUERIES[name](spark, large).collect())) == sorted(want)


def test_paths_and_subtrees_of_a_page_of_several_batches(spark):
    reader = html.NodeReader()
    reader.feed("<div>" * 2000 + "<img></div><b>x</b></i>" + "</div>" * 1999 + "<p>end")
    reader.close()
    got = [row for b in reader.batches(7) for row in b.to_pylist()]
    assert len(list(reader.batches(7))) == 2 and [r["node"] for r in got] == list(range(2003))
    last = {}
    for r in got:
        for above in r["path"]:
            last[above] = r["node"]
    assert [r["last"] for r in got] == [last[r["node"]] for r in got]
    assert got[2000]["path"] == list(range(2001)) and got[2001]["path"] == [*range(1999), 2001] and got[2002]["path"] == [2002]


def test_greedy_cards_of_random_pages(spark):
    import random

    rng = random.Random(5)
    pages = [(p, "".join(rng.choice(("<div>", "<p>", "</div>", "</p>", "<img>")) for _ in range(60))) for p in range(30)]
    nodes = html.page_nodes(spark.createDataFrame(pages, "page_id long, html string"))
    scored = nodes.where("node % 7 <> 3").select("page_id", "node", (F.col("node") * 11 % 5).alias("score"), (F.col("node") * 3 % 4).alias("length"))
    path, want, found = {(r.page_id, r.node): set(r.path) for r in nodes.collect()}, {}, {}
    for r in sorted(scored.collect(), key=lambda r: (r.page_id, -r.score, r.length, r.node)):
        taken = want.setdefault(r.page_id, set())
        if not any(w in path[r.page_id, r.node] or r.node in path[r.page_id, w] for w in taken):
            taken.add(r.node)
    for r in tree.greedy_cards(nodes, scored).collect():
        found.setdefault(r.page_id, set()).add(r.node)
    assert found == want and want

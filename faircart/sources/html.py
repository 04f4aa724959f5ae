"""Pages as relations: a node table with materialised paths, and products from embedded JSON."""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.privacy import redact
from ..functions.text import squeeze, strict_json

# Elements that never have content, and those whose text is not shown.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset(("script", "style", "template", "noscript"))
#: A page is sent in batches of about so many path entries, so pages of any size and depth need little beyond their own nodes.
BATCH_STEPS = 1 << 20
NODE = "page_id long, node int, path array<int>, tag string, text string, label string, href string, last int"


class NodeReader(HTMLParser):
    """Collects ``(parent, tag, own text, label, href)`` in document order, -1 above a root; a small helper for one page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes, self.open, self.names = [], [], Counter()

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        label = " ".join(given[k] for k in ("aria-label", "alt", "title") if given.get(k))
        self.nodes.append([self.open[-1][0] if self.open else -1, tag, [], label or None, given.get("href")])
        if tag not in VOID:
            self.open.append((len(self.nodes) - 1, tag))
            self.names[tag] += 1

    def handle_endtag(self, tag):
        if self.names[tag]:
            closed = None
            while closed != tag:
                closed = self.open.pop()[1]
                self.names[closed] -= 1

    def handle_data(self, data):
        if self.open and data.strip() and self.open[-1][1] not in HIDDEN:
            self.nodes[self.open[-1][0]][2].append(data)

    def last(self) -> list[int]:
        """The last node of each node's subtree, itself without others below it."""
        last = list(range(len(self.nodes)))
        for i in range(len(last) - 1, -1, -1):
            if (parent := self.nodes[i][0]) >= 0:
                last[parent] = max(last[parent], last[i])
        return last

    def batches(self, page_id: int) -> Iterator[pa.RecordBatch]:
        """The nodes as rows of ``NODE``, their paths held for one batch only."""
        last, path, first = self.last(), [], 0
        steps, ends = array("i"), array("i", [0])
        for i, (parent, *_) in enumerate(self.nodes):
            while path and path[-1] != parent:
                path.pop()
            path.append(i)
            steps.extend(path)
            ends.append(len(steps))
            if len(steps) >= BATCH_STEPS or i + 1 == len(self.nodes):
                _, tags, texts, labels, hrefs = zip(*self.nodes[first : i + 1], strict=True)
                paths = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(steps, pa.int32()))
                own = [" ".join(t) or None for t in texts]
                places = pa.array([page_id] * len(tags), pa.int64()), pa.array(range(first, i + 1), pa.int32()), paths
                told = (pa.array(c, pa.string()) for c in (tags, own, labels, hrefs))
                yield pa.RecordBatch.from_arrays([*places, *told, pa.array(last[first : i + 1], pa.int32())], names=[f.split()[0] for f in NODE.split(", ")])
                first, steps, ends = i + 1, array("i"), array("i", [0])


def page_nodes(pages: DataFrame) -> DataFrame:
    """One row per element of ``pages(page_id, html)``: ``(page_id, node, path, tag, text, label, href, last)``.

    ``node`` counts in document order; ``path`` lists the nodes from the root down to the node itself, so ancestors need no
    recursion; ``last`` is the last node below it, or itself. ``text`` is the node's own text, squeezed and redacted. Every
    element of a page counts, however many there are. Null html gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for page_id, html in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                reader = NodeReader()
                reader.feed(html.as_py() or "")
                reader.close()
                yield from reader.batches(page_id)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(run, NODE)
    return rows.withColumn("text", redact(squeeze(F.col("text")))).withColumn("label", redact(F.col("label")))


def json_ld_products(pages: DataFrame) -> DataFrame:
    """Products of embedded JSON-LD in ``pages(page_id, html)``: ``(page_id, title, cents)``.

    Bad JSON is skipped; arrays and ``@graph`` are flattened, three levels deep; other nested objects are not visited. A product is an
    object whose ``@type`` is or holds Product, whatever the case. Its title is its name, else its headline, else the page's.
    The price is that of its first offer.
    """
    script = r"(?is)<script\b[^>]*type\s*=\s*[\"']?application/ld\+json[\"']?[^>]*>(.*?)</script>"
    title = squeeze(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    rows = pages.select("page_id", title.alias("page_title"), F.explode(F.regexp_extract_all("html", F.lit(script), F.lit(1))).alias("body"))
    rows = rows.select("page_id", "page_title", strict_json(F.col("body")).cast("string").alias("v")).where("v is not null")
    for _ in range(3):
        items = F.from_json("v", "array<string>")
        graph = F.when(F.startswith(F.get_json_object("v", "$.@graph"), F.lit("[")), F.from_json(F.get_json_object("v", "$.@graph"), "array<string>"))
        own = F.when(F.startswith("v", F.lit("[")), items).otherwise(F.concat(F.array("v"), F.coalesce(graph, F.array().cast("array<string>"))))
        done = F.transform(own, lambda x, i: F.struct(x.alias("v"), ((i == 0) & ~F.startswith(F.col("v"), F.lit("["))).alias("seen")))
        before = F.col("seen") if "seen" in rows.columns else F.lit(False)
        flat = F.when(before, F.array(F.struct(F.col("v"), F.lit(True).alias("seen")))).otherwise(done)
        rows = rows.select("page_id", "page_title", F.explode(flat).alias("x")).select("page_id", "page_title", "x.v", "x.seen")
    kind = F.lower(F.get_json_object("v", "$.@type"))
    rows = rows.where((kind == "product") | kind.rlike(r'^\[.*"product".*\]$'))
    name = F.coalesce(F.get_json_object("v", "$.name"), F.get_json_object("v", "$.headline"), F.col("page_title"))
    return rows.select("page_id", name.alias("title"), offer_cents(F.col("v")).alias("cents"))


def offer_cents(product: Column) -> Column:
    """The price of a product's first offer in cents, half up; null without a number at its start."""
    price = F.coalesce(F.get_json_object(product, "$.offers.price"), F.get_json_object(product, "$.offers[0].price"))
    number = F.regexp_extract(price, r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)", 0)
    return F.when(number != "", F.floor(number.cast("double") * 100 + 0.5).cast("long"))

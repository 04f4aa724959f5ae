"""URL rules whose decisions reach aliases over redirect and canonical-link edges.

A page's own rule decides first. A page without one takes the decision of its redirect
equivalence class: the connected component of its URL over redirects and canonical links. In
a class, an explicit allow on any URL comes before any block.

Edges are canonical links and refresh redirects in the pages, recorded redirects, and the
canonical form of every URL (http for https, no default port, no tracking parameters, no default
document, no slash at the end), to which servers redirect its other spellings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialise, table
from .components import connected_components

#: Fixed by the query's contract: verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
CANONICAL = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
REFRESH_URL = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for no ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.substring(url, at + 3, F.length(url))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    none = F.lit("")
    return F.when(at > 0, ascii_lower(host)).otherwise(none), F.when(at > 0, path).otherwise(none)


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null without one."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, own_host, own_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(own_path)
        text = F.when(fits, own_host + own_path).otherwise(text)
        verdict = F.when(fits, kind).otherwise(verdict)
    return text, verdict


def url_node(url: Column) -> Column:
    """A URL as a graph node: scheme and host lower-cased, no fragment; null for no ``://``."""
    whole = F.regexp_extract(url, r"(?s)^([^:/?#]*://[^/?#]*)([^#]*)", 1)
    rest = F.regexp_extract(url, r"(?s)^([^:/?#]*://[^/?#]*)([^#]*)", 2)
    return F.when(whole != "", F.concat(ascii_lower(whole), F.when(rest == "", "/").otherwise(rest)))


#: Query parameters that only track a visit, default ports and default documents.
TRACKING = r"^(?:utm_[a-z]+|gclid|fbclid|msclkid|ref)="
DEFAULT_PORT = r"^(http://[^/?]*):(?:80|443)(?=[/?]|$)"
DEFAULT_DOCUMENT = r"/(?:index\.(?:html?|php)|default\.aspx?)$"


def canonical_node(node: Column) -> Column:
    """The canonical spelling of a URL node, itself a node."""
    plain = F.regexp_replace(F.regexp_replace(node, "^https://", "http://"), DEFAULT_PORT, "$1")
    address, query = F.regexp_extract(plain, r"(?s)^[^?]*", 0), F.regexp_extract(plain, r"(?s)\?(.*)$", 1)
    address = F.regexp_replace(address, DEFAULT_DOCUMENT, "/")
    short = F.regexp_replace(address, r"(?<=[^/:])/+$", "")
    root = short.rlike(r"^[^:/?#]*://[^/]*$")
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    return F.concat(short, F.when(root, "/").otherwise(""), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def resolved(base: Column, link: Column) -> Column:
    """An HTML link against the URL of its page; null if there is nothing to point to."""
    link = F.replace(F.trim(link), F.lit("&amp;"), F.lit("&"))
    root = F.regexp_extract(base, r"(?s)^([^:/?#]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^([^:/?#]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.rlike("^//"), F.concat(F.regexp_extract(base, "^([^:/?#]*:)", 1), link))
        .when(link.rlike("^/"), F.concat(root, link))
        .when((link == "") | link.rlike("^#") | link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), link))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """``(src, dst)`` URLs of canonical links and refresh redirects in ``pages(url, html)``."""
    html = F.col("html").cast("string")
    found = F.concat(
        F.when(
            html.rlike("(?i)canonical"),
            F.transform(F.regexp_extract_all(html, F.lit(CANONICAL), F.lit(0)), lambda t: F.regexp_extract(t, HREF, 1)),
        ).otherwise(F.array().cast("array<string>")),
        F.when(
            html.rlike("(?i)http-equiv"),
            F.transform(F.regexp_extract_all(html, F.lit(REFRESH), F.lit(0)), lambda t: F.regexp_extract(t, REFRESH_URL, 1)),
        ).otherwise(F.array().cast("array<string>")),
    )
    links = pages.select(F.col("url").cast("string").alias("src"), F.explode(found).alias("link"))
    return links.select("src", resolved(F.col("src"), F.col("link")).alias("dst")).where("dst is not null")


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` per row of ``pages(page_id, url, html)``.

    ``redirects(src, dst)`` adds recorded redirects to the links in the pages. A page with no rule
    and no decided alias gets ``default``. Null urls and urls without ``://`` have an empty host
    and path and no rule. Repeated rows keep their rows, other columns are ignored, an empty table
    gives no rows.
    """
    edges = page_links(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("src", "dst"))
    edges = edges.select(url_node(F.col("src")).alias("src"), url_node(F.col("dst")).alias("dst")).where("src is not null and dst is not null")
    # Every end of an edge, and every page's own URL, stands in one class with its canonical spelling.
    named = pages.select(url_node(F.col("url").cast("string")).alias("node")).unionByName(edges.select(F.explode(F.array("src", "dst")).alias("node")))
    spelt = named.select(F.col("node").alias("src"), canonical_node(F.col("node")).alias("dst")).where("src <> dst").distinct()
    edges = materialise(edges.unionByName(spelt), "url-edges")
    classes = connected_components(edges)
    host, path = host_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    rows = rows.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("own"))
    columns = ["page_id", "host", "path", "rule"]
    if classes.isEmpty():
        return rows.select(*columns, F.coalesce("own", F.lit(default)).alias("verdict"))
    h, p = host_path(F.col("node"))
    nodes = classes.withColumn("kind", longest_rule(h, p, rules)[1])
    kinds = nodes.groupBy("component").agg(F.min("kind").alias("kind"))  # "allow" comes before "block"
    told = classes.join(kinds.where("kind is not null"), "component").select("node", "kind")
    plain = rows.where("rule is null").withColumn("node", url_node(F.col("url")))
    plain = plain.join(told, "node", "left").select(*columns, F.coalesce("kind", F.lit(default)).alias("verdict"))
    return rows.where("rule is not null").select(*columns, F.col("own").alias("verdict")).unionByName(plain)


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the urls of all ``pages``."""
    return judge(table(spark, sf_dir, "pages"))

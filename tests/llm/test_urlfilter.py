import re
from urllib.parse import urljoin

from faircart.llm import urlfilter as uf


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule(url):
    host, path = parts(url)
    fit = [r for r in uf.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return max(fit, key=lambda r: len(r[1] + r[2]), default=None)


def node(url):
    m = re.match(r"([^:/?#]*://[^/?#]*)([^#]*)", url or "")
    return m[1].lower() + (m[2] or "/") if m else None


def canonical(n):
    n = re.sub("^https://", "http://", n)
    n = re.sub(r"^(http://[^/?]*):(80|443)(?=[/?]|$)", r"\1", n)
    address, _, query = n.partition("?")
    address = re.sub(r"/(index\.html?|index\.php|default\.aspx?)$", "/", address)
    scheme, rest = address.split("://", 1)
    host, _, path = rest.partition("/")
    path = path.rstrip("/")
    kept = [p for p in query.split("&") if p and not re.match("(utm_[a-z]+|gclid|fbclid|msclkid|ref)=", p)]
    return f"{scheme}://{host}/{path}" + ("?" + "&".join(kept) if kept else "")


def brute(rows, redirects=()):
    edges = [e for e in redirects if node(e[0]) and node(e[1])]
    for _, url, html in rows:
        for tag in re.findall(r"(?i)<link[^>]*canonical[^>]*>|<meta[^>]*refresh[^>]*>", html or ""):
            link = re.search(r"(?i)(?:href|url)\s*=\s*[\"']?([^\"'\s>]+)", tag)
            if url and link:
                edges.append((url, urljoin(url, link[1].replace("&amp;", "&"))))
    group = {}

    def root(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    nodes = {node(u) for _, u, _ in rows} | {node(u) for e in edges for u in e}
    for a, b in [(node(a), node(b)) for a, b in edges] + [(n, canonical(n)) for n in nodes if n]:
        if a and b:
            group[root(a)] = root(b)
    kinds = {}
    for n in list(group):
        if rule(n):
            kinds.setdefault(root(n), set()).add(rule(n)[0])
    out = []
    for page_id, url, _ in rows:
        own, n = rule(url), node(url)
        seen = kinds.get(root(n), set()) if n in group else set()
        verdict = own[0] if own else "allow" if "allow" in seen or not seen else "block"
        out.append((page_id, *parts(url), own and own[1] + own[2], verdict))
    return sorted(out, key=str)


LINK = '<html><head><link rel="canonical" href="%s"></head>'
ROWS = [
    (1, "http://A.example.com/en/1#x", "<p>"),
    (2, "http://www.Example.com/en/1", ""),
    (3, "https://a.org/x", LINK % "http://a.example.com/en/1"),
    (4, "https://b.org/y", LINK % "https://a.org/x?q"),
    (5, "https://a.org/x?q", LINK % "/x"),
    (6, "https://c.net/de/1", '<meta http-equiv=refresh content="0; url=//d.net/fr/1">'),
    (7, "https://d.net/fr/1?z=1", None),
    (8, "https://e.org", LINK % "sub/z#f" + LINK % "http://www.example.com/en/q"),
    (9, "https://e.org/sub/z", LINK % "http://x.net/es/"),
    (10, None, LINK % "http://x.net/es/"),
    (11, "no scheme", ""),
    (12, "", ""),
    (13, "http://com", ""),
    (14, "http://xexample.com/en/", ""),
    (15, "http://net/es/?a#b", ""),
    (16, "http://q?/com/", ""),
    (17, "a?u=http://k.example.com/en/", ""),
    (18, "https://hop0.org/", ""),
    (None, "https://hop9.org/", ""),
    (3, "https://a.org/x", LINK % "http://a.example.com/en/1"),
    (20, "https://f.org:443/a/index.html?utm_source=feed&k=1", LINK % "http://net/fr/1"),
    (21, "http://f.org/a?k=1&ref=x#top", ""),
    (22, "http://g.org:80", ""),
    (23, "https://G.org/?gclid=5", LINK % "http://com/a"),
    (19, "https://long.org/" + "x" * 100_000, "<p>" * 50_000),
]


def test_matches_brute_force(spark):
    hops = [(f"https://hop{i}.org/", f"https://hop{i + 1}.org") for i in range(12)] + [("https://HOP12.org#a", "http://net/fr/a"), (None, "http://b")]
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "1 as rule", "'x' as node")
    assert sorted((tuple(r) for r in uf.judge(pages).collect()), key=str) == brute(ROWS)
    redirects = spark.createDataFrame(hops, "src string, dst string")
    got = sorted((tuple(r) for r in uf.judge(pages.repartition(3), redirects=redirects).collect()), key=str)
    assert got == brute(ROWS, hops)
    decided = {r[0]: r[4] for r in got}
    assert decided[20] == decided[21] == "block" and decided[22] == decided[23] == "allow"
    verdict = {(r[0], r[1]): r[4] for r in got}
    assert verdict[3, "a.org"] == verdict[4, "b.org"] == "block" and verdict[8, "e.org"] == "allow"
    assert verdict[18, "hop0.org"] == verdict[None, "hop9.org"] == "block"


def test_empty_and_query(spark, sf_dir):
    assert uf.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted((tuple(r) for r in uf.op4_urls(spark, sf_dir).collect()), key=str) == brute(rows)


def test_pages_hold_aliases(spark):
    """In the given pages other spellings stand beside one another; they agree in host and path, so in the verdict."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    node = pages.select(uf.url_node(pages.url).alias("node"))
    spelt = node.select("node", uf.canonical_node(node.node).alias("canonical"))
    assert spelt.where("node <> canonical").count() > 1_000
    assert spelt.groupBy("canonical").count().where("count > 1").count() > 0

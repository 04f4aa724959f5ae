"""Queries over text, URL and answer functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, grammar, privacy, text
from .common import dealt, registry, table

QUERIES, ORACLE_SQL, query = registry()


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


URL_PATH = "regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1)"
URL_HOST = "lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1))"


@query(
    "url_parts",
    rf"""SELECT page_id, regexp_extract(url, '^([a-zA-Z]+://[^/?#]+[^?#]*)', 1) AS clean,
      CASE WHEN regexp_matches({URL_PATH}, '(?i)/(?:ip|dp|p|product)/') THEN 'product' WHEN regexp_matches({URL_PATH}, '(?i)cart|checkout') THEN 'cart'
        WHEN regexp_matches({URL_PATH}, '(?i)search|s\?|browse|category|cat') THEN 'search' ELSE 'unknown' END AS page_type,
      {URL_HOST} = 'example.com' OR {URL_HOST} LIKE '%.example.com' OR ends_with('example.com', '.' || {URL_HOST}) AS same_site FROM pages""",
)
def url_parts(spark, sf_dir):
    """Origin and path, kind of page, and whether the host belongs to a site."""
    u = F.col("url")
    path, host = F.regexp_extract(u, "^[a-zA-Z]+://[^/?#]+([^?#]*)", 1), F.regexp_extract(u, "^[a-zA-Z]+://([^/?#]*)", 1)
    return table(spark, sf_dir, "pages").select(
        "page_id", text.sanitize_url(u).alias("clean"), text.page_type(path).alias("page_type"), text.same_site(F.lit("example.com"), host).alias("same_site")
    )


@query(
    "slugs",
    r"""SELECT conv_id, turn, substr(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80) AS slug
    FROM conversations WHERE text IS NOT NULL""",
)
def slugs(spark, sf_dir):
    """Texts as slugs."""
    return table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", text.slugify(F.col("text")).alias("slug"))


@query(
    "text_hash",
    """WITH h AS (SELECT c_custkey, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(c_name, ''), lambda c: unicode(c)::BIGINT)),
      lambda a, c: (a * 31 + c) % 4294967296) AS h FROM customer)
    SELECT c_custkey, lower(to_base(abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END), 36)) AS hash FROM h""",
)
def text_hash(spark, sf_dir):
    """Short ids of titles."""
    return table(spark, sf_dir, "customer").select("c_custkey", text.hash_text(F.col("c_name")).alias("hash"))


@query(
    "index_codes",
    """SELECT p_partkey, CASE WHEN p_partkey % 1400 < 1296 THEN lpad(to_base(p_partkey % 1400, 36), 2, '0') END AS code,
      CAST(floor(p_size / 64.0 * 1000 + 0.5) AS BIGINT) AS coordinate FROM part""",
)
def index_codes(spark, sf_dir):
    """Two-digit index codes and thousandths of a size."""
    code = text.base36(F.col("p_partkey") % 1400)
    return table(spark, sf_dir, "part").select("p_partkey", code.alias("code"), text.normalize_coordinate(F.col("p_size").cast("double"), F.lit(64.0)).alias("coordinate"))


def sql_singular(w: str) -> str:
    return f"""CASE WHEN length({w}) > 4 AND {w} LIKE '%ies' THEN left({w}, length({w}) - 3) || 'y'
      WHEN length({w}) > 3 AND {w} LIKE '%s' AND {w} NOT LIKE '%ss' THEN left({w}, length({w}) - 1) ELSE {w} END"""


def sql_search(t: str, stop: str) -> str:
    words = f"list_filter(regexp_split_to_array(translate(lower({t}), '{text.MARKED}', '{text.PLAIN}'), '[^a-z0-9]+'), lambda w: length(w) > 1)"
    return f"list_filter(list_transform({words}, lambda w: {sql_singular('w')}), lambda w: NOT list_contains({stop}, w))"


def sql_query(t: str) -> str:
    words = f"""list_filter(regexp_split_to_array(translate(lower({t}), '{text.MARKED}', '{text.PLAIN}'), '[^a-z0-9]+'),
      lambda w: w <> '' AND NOT list_contains(['and', 'or', 'of', 'the'], w))"""
    es = "length(w) > 4 AND w NOT LIKE '%ies' AND regexp_matches(w, '(ches|shes|sses|xes|zes)$')"
    return f"list_distinct(list_transform({words}, lambda w: CASE WHEN {es} THEN left(w, length(w) - 2) ELSE {sql_singular('w')} END))"


STOP = "['all', 'and', 'for', 'of', 'purpose', 'the', 'with']"


@query(
    "query_coverage",
    f"""WITH p AS (SELECT a.conv_id, a.turn, {sql_search("a.text", STOP)} AS q, {sql_search("b.text", "['']")} AS e
      FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn WHERE a.text IS NOT NULL AND b.text IS NOT NULL)
    SELECT conv_id, turn, CASE WHEN len(q) = 0 THEN 1.0 ELSE len(list_filter(q, lambda w: list_contains(e, w)))::DOUBLE / len(q) END AS coverage FROM p""",
)
def query_coverage(spark, sf_dir):
    """The share of a turn's words that the next turn takes up."""
    c = table(spark, sf_dir, "conversations").where("text is not null")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("after"))
    return c.join(after, ["conv_id", "turn"]).select("conv_id", "turn", text.query_coverage(F.col("text"), F.col("after")).alias("coverage"))


@query(
    "query_match",
    f"""WITH p AS (SELECT a.p_partkey, {sql_query("concat(a.p_name, ' ', a.p_type, ' boxes and batteries')")} AS e,
      {sql_query("concat(split_part(a.p_name, ' ', 1), CASE a.p_partkey % 4 WHEN 0 THEN ' box' WHEN 1 THEN ' the battery' WHEN 2 THEN ' lamp' ELSE '' END)")} AS q FROM part a)
    SELECT p_partkey, len(q) > 0 AND len(list_filter(q, lambda w: NOT list_contains(e, w))) = 0 AS fits FROM p""",
)
def query_match(spark, sf_dir):
    """Whether a title holds every word of a query."""
    k = F.col("p_partkey") % 4
    asked = F.concat(F.split("p_name", " ")[0], F.when(k == 0, " box").when(k == 1, " the battery").when(k == 2, " lamp").otherwise(""))
    title = F.concat("p_name", F.lit(" "), "p_type", F.lit(" boxes and batteries"))
    return table(spark, sf_dir, "part").select("p_partkey", text.matches_query(title, asked).alias("fits"))


NOTES = ("Access denied", "please Verify you are human", "captchas are fine", "Unusual traffic from here", "nothing of the kind", "Robot or human?", "secure your accessories")


def notes(column: str):
    return F.concat("p_name", F.lit(" "), F.element_at(F.array(*map(F.lit, NOTES)), (F.col(column) % len(NOTES) + 1).cast("int")))


SQL_NOTES = f"concat(p_name, ' ', [{', '.join(map(quoted, NOTES))}][CAST(p_partkey % {len(NOTES)} + 1 AS INTEGER)])"


@query("bot_challenges", f"SELECT p_partkey, regexp_matches({SQL_NOTES}, {quoted('(?i)' + text.CHALLENGE)}) AS challenge FROM part")
def bot_challenges(spark, sf_dir):
    """Pages that ask who is there."""
    return table(spark, sf_dir, "part").select("p_partkey", text.is_bot_challenge(notes("p_partkey")).alias("challenge"))


SQUEEZED = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@query(
    "text_similarity",
    f"""WITH p AS (SELECT doc_id, {SQUEEZED.format("d.text")} AS a, {SQUEEZED.format("b.text")} AS b FROM documents d JOIN benchmark b ON d.doc_id % 40 = b.item_id
      WHERE d.text IS NOT NULL AND b.text IS NOT NULL),
    w AS (SELECT *, list_distinct(string_split(a, ' ')) AS x, list_distinct(string_split(b, ' ')) AS y FROM p)
    SELECT doc_id, CASE WHEN a = '' OR b = '' THEN 0.0 WHEN contains(a, b) OR contains(b, a) THEN 1.0
      ELSE floor(len(list_intersect(x, y)) * 2 / (len(x) + len(y)) * 10000 + 0.5) / 10000 END AS similarity FROM w""",
)
def text_similarity(spark, sf_dir):
    """How alike documents and test items are by their words."""
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    pairs = d.join(b, F.col("doc_id") % 40 == F.col("item_id")).where("text is not null and item is not null")
    s = text.text_similarity(F.col("text"), F.col("item"))
    return pairs.select("doc_id", (F.floor(s * 10000 + 0.5) / 10000).alias("similarity"))


@query(
    "evidence_groups",
    """SELECT substr(sha256(concat('{"role":"', role, '","text":', to_json(text), '}')), 1, 20) AS signature, count(*) AS outputs, min(conv_id) AS first_conv
    FROM conversations WHERE text IS NOT NULL AND NOT regexp_matches(text, '["\\\\\\x00-\\x1f]') GROUP BY ALL""",
)
def evidence_groups(spark, sf_dir):
    """Equal evidence shares a signature of its canonical JSON."""
    c = table(spark, sf_dir, "conversations").where(F.col("text").isNotNull() & ~F.col("text").rlike(r'["\\\x00-\x1f]'))
    signature = text.evidence_signature(F.to_json(F.struct("role", "text")))
    return c.groupBy(signature.alias("signature")).agg(F.count("*").alias("outputs"), F.min("conv_id").alias("first_conv"))


@query(
    "json_answers",
    r"""WITH t AS (SELECT event_id, props, CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN concat('answer: ', props, ' done }') WHEN 2 THEN concat('{"a": "}\" {", "b": ', props, '} x')
      WHEN 3 THEN substr(props, 1, 4) ELSE 'none' END AS answer FROM events WHERE props IS NOT NULL)
    SELECT event_id, event_id % 5 = 0 AS strict, CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN props WHEN 2 THEN concat('{"a": "}\" {", "b": ', props, '}') END AS prefix FROM t""",
)
def json_answers(spark, sf_dir):
    """Strict JSON, and the first balanced object of an answer."""
    k, p = F.col("event_id") % 5, F.col("props")
    answer = (
        F.when(k == 0, p)
        .when(k == 1, F.concat(F.lit("answer: "), p, F.lit(" done }")))
        .when(k == 2, F.concat(F.lit('{"a": "}\\" {", "b": '), p, F.lit("} x")))
        .when(k == 3, F.substring(p, 1, 4))
        .otherwise("none")
    )
    rows = table(spark, sf_dir, "events").where("props is not null").select("event_id", answer.alias("answer"))
    return rows.select("event_id", text.strict_json(F.col("answer")).isNotNull().alias("strict"), grammar.json_prefix(F.col("answer")).alias("prefix"))


REASONS = ("passed screening, coherent page", "HTTP 403 from host", "candidate obstruction", "timeout at the deadline", "nothing known", "404 on search route", "bot challenge")


@query(
    "recoverability",
    f"""WITH r AS (SELECT o_orderkey, [{", ".join(map(quoted, REASONS))}][CAST(o_orderkey % {len(REASONS)} + 1 AS INTEGER)] AS reason FROM orders)
    SELECT o_orderkey, {" + ".join(f"CASE WHEN regexp_matches(reason, {quoted('(?i)' + p)}) THEN {w} ELSE 0 END" for p, w in text.RECOVERABLE)} AS score FROM r""",
)
def recoverability(spark, sf_dir):
    """How well another attempt may go."""
    reason = F.element_at(F.array(*map(F.lit, REASONS)), (F.col("o_orderkey") % len(REASONS) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.recoverability(reason).alias("score"))


ANSWERS = (" valid", "INVALID_PRODUCT_SPEC", "invalid_unrelated_attribute ", "INVALID_EVIDENCE_MISMATCH", "Uncertain", "maybe", "")


@query(
    "review_decisions",
    f"""WITH a AS (SELECT o_orderkey, upper(trim([{", ".join(map(quoted, ANSWERS))}][CAST(o_orderkey % {len(ANSWERS)} + 1 AS INTEGER)])) AS a FROM orders)
    SELECT o_orderkey, CASE a {" ".join(f"WHEN '{k}' THEN '{d}'" for k, (d, _) in text.DECISIONS.items())} ELSE 'uncertain' END AS decision,
      CASE a {" ".join(f"WHEN '{k}' THEN '{r}'" for k, (_, r) in text.DECISIONS.items())} ELSE 'invalid-model-response' END AS reason FROM a""",
)
def review_decisions(spark, sf_dir):
    """L3: answers of a review model as decision and reason."""
    answer = F.element_at(F.array(*map(F.lit, ANSWERS)), (F.col("o_orderkey") % len(ANSWERS) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.parse_decision(answer).alias("d")).select("o_orderkey", "d.decision", "d.reason")


LABELS = ("Read more", "In stock", "Save 20% now!", "Great lamp", "Sold out today", "best in class", "5.5 out of 5 stars 12 reviews", "12 fl oz", "Add to list", "Wool blanket, grey")


@query(
    "title_filters",
    f"""WITH t AS (SELECT p_partkey, [{", ".join(map(quoted, LABELS))}][CAST(p_partkey % {len(LABELS)} + 1 AS INTEGER)] AS t FROM part)
    SELECT p_partkey, regexp_matches(t, {quoted("(?i)" + classify.MERCHANDISING)}) AS label,
      CASE WHEN length(t) BETWEEN 5 AND 260 AND NOT ({" OR ".join(f"regexp_matches(t, {quoted('(?i)' + p)})" for p in classify.NOT_ANNOTATED)}) THEN t END AS title FROM t""",
)
def title_filters(spark, sf_dir):
    """Labels that are no titles."""
    t = F.element_at(F.array(*map(F.lit, LABELS)), (F.col("p_partkey") % len(LABELS) + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", t.alias("t"))
    return rows.select("p_partkey", classify.is_merchandising(F.col("t")).alias("label"), classify.clean_annotation_title(F.col("t")).alias("title"))


CARD = "concat(repeat(p_name || ' ', CAST(1 + p_partkey % 300 AS INTEGER)), CASE p_partkey % 4 WHEN 0 THEN '€ 4.50 / lb add' WHEN 1 THEN '$12 pack' WHEN 2 THEN '£3 per roll' ELSE 'no price' END)"


@query(
    "collected_cards",
    f"""WITH c AS (SELECT p_partkey, p_partkey % 3 = 0 AS link, p_partkey % 5 = 0 AS media, p_partkey % 7 = 0 AS schema, {CARD} AS t FROM part)
    SELECT p_partkey, CASE WHEN length(t) BETWEEN 24 AND 2800 AND regexp_matches(t, '[$€£]\\s*\\d') THEN 4 + CASE WHEN link THEN 2 ELSE 0 END + CASE WHEN media THEN 1 ELSE 0 END
      + CASE WHEN schema THEN 2 ELSE 0 END + {" + ".join(f"CASE WHEN regexp_matches(t, {quoted('(?i)' + p)}) THEN {n} ELSE 0 END" for n, p in classify.COLLECTED)} ELSE 0 END AS score FROM c""",
)
def collected_cards(spark, sf_dir):
    """The collector's score of page elements."""
    k = F.col("p_partkey")
    t = F.when(k % 4 == 0, "€ 4.50 / lb add").when(k % 4 == 1, "$12 pack").when(k % 4 == 2, "£3 per roll").otherwise("no price")
    rows = dealt(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", F.concat(F.repeat(F.concat("p_name", F.lit(" ")), (k % 300 + 1).cast("int")), t).alias("t"))
    return rows.select("p_partkey", classify.collected_card_score(F.col("t"), k % 3 == 0, k % 5 == 0, k % 7 == 0).alias("score"))


def sql_redacted(t: str) -> str:
    for _, p, mark in privacy.REDACTED:
        t = f"regexp_replace({t}, {quoted('(?i)' + p)}, '[REDACTED {mark}]', 'g')"
    return t


@query("pii_redaction", f"SELECT doc_id, {sql_redacted('text')} AS text FROM documents WHERE text IS NOT NULL")
def pii_redaction(spark, sf_dir):
    """Whole documents with personal data replaced by marks."""
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", privacy.redact(F.col("text")).alias("text"))


SQL_SENSITIVE = ", ".join(f"CASE WHEN regexp_matches(text, {quoted(('' if cased else '(?i)') + p)}) THEN '{label}' END" for label, p, cased in privacy.SENSITIVE)


@query(
    "sensitive_text",
    f"""WITH f AS (SELECT doc_id, list_filter([{SQL_SENSITIVE}], lambda x: x IS NOT NULL) AS labels FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, array_to_string(list_sort(labels), ',') AS labels FROM f WHERE len(labels) > 0""",
)
def sensitive_text(spark, sf_dir):
    """Labels of what must not be published, per document."""
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", privacy.sensitive_labels(F.col("text")).alias("labels"))
    return rows.where(F.size("labels") > 0).select("doc_id", F.array_join("labels", ",").alias("labels"))


SQL_FINDINGS = " UNION ALL ".join(f"SELECT doc_id AS id, 'documents' AS source, '{c}' AS category FROM documents WHERE regexp_matches(text, {quoted('(?i)' + p)})" for c, p, _ in privacy.REDACTED)


@query(
    "privacy_audit",
    f"""{SQL_FINDINGS} UNION ALL SELECT page_id, 'pages', 'sensitive-url-parameter' FROM pages
    WHERE len(list_filter(string_split(regexp_extract(url || '&token=' || (page_id % 3 = 0), '\\?([^#]*)', 1), '&'), lambda p: regexp_matches(split_part(p, '=', 1), {quoted("(?i)" + privacy.SENSITIVE_KEY)}))) > 0""",
)
def privacy_audit(spark, sf_dir):
    """Findings of personal data in texts and URLs, one row each."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("documents").alias("source"), F.explode(privacy.text_findings(F.col("text"))).alias("category"))
    url = F.concat("url", F.lit("&token="), (F.col("page_id") % 3 == 0).cast("string"))
    pages = table(spark, sf_dir, "pages").where(privacy.url_has_sensitive_key(url))
    return docs.unionByName(pages.select(F.col("page_id").alias("id"), F.lit("pages").alias("source"), F.lit("sensitive-url-parameter").alias("category")))


@query(
    "cross_source_titles",
    """SELECT sha256(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS hash, count(DISTINCT source) AS sources, count(*) AS documents
    FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source) > 1""",
)
def cross_source_titles(spark, sf_dir):
    """texts that stand in more than one source."""
    d = table(spark, sf_dir, "documents").where("text is not null").groupBy(text.title_hash(F.col("text")).alias("hash"))
    return d.agg(F.countDistinct("source").alias("sources"), F.count("*").alias("documents")).where("sources > 1")


POINTERS = (
    ("CARD n{i}\nTITLE n{i},t\nCURRENT_PRICE n@p0\nNATIVE_UNIT_PRICE NONE\nPACKAGE_QUANTITY n@q1\nPACK_COUNT NONE\nSTATUS comparable", None),
    ("CARD n{i}\nTITLE n{i}\nCURRENT_PRICE NONE\nNATIVE_UNIT_PRICE NONE\nPACKAGE_QUANTITY NONE\nPACK_COUNT NONE\nSTATUS price-range", None),
    ("CARD n{i}\nTITLE n{i}\nCURRENT_PRICE n@p0\nNATIVE_UNIT_PRICE NONE\nPACKAGE_QUANTITY NONE\nPACK_COUNT NONE\nSTATUS comparable", "incompatible-status"),
    ("CARD n{i}\nTITLE n{i}\nSTATUS comparable", "invalid-line-count"),
    ("CARD n{i}\nTITLE n{i}\nPRICE n@p0\nNATIVE_UNIT_PRICE NONE\nPACKAGE_QUANTITY NONE\nPACK_COUNT NONE\nSTATUS comparable", "invalid-field"),
    ("CARD n {i}\nTITLE n{i}\nCURRENT_PRICE NONE\nNATIVE_UNIT_PRICE NONE\nPACKAGE_QUANTITY NONE\nPACK_COUNT NONE\nSTATUS price-range", "invalid-node"),
    ("CARD n{i}\nTITLE n{i}\nCURRENT_PRICE n@q0\nNATIVE_UNIT_PRICE NONE\nPACKAGE_QUANTITY NONE\nPACK_COUNT NONE\nSTATUS comparable", "invalid-candidate"),
    ("CARD n{i}\nTITLE n{i}\nCURRENT_PRICE NONE\nNATIVE_UNIT_PRICE NONE\nPACKAGE_QUANTITY NONE\nPACK_COUNT NONE\nSTATUS sold", "invalid-status"),
)


@query(
    "pointer_parse",
    "SELECT p_partkey, CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN {'NULL' if r is None else quoted(r)}" for i, (_, r) in enumerate(POINTERS)) + " END AS issue FROM part",
)
def pointer_parse(spark, sf_dir):
    """Seven-line answers and what is wrong with them."""
    t = F.element_at(F.array(*(F.lit(p) for p, _ in POINTERS)), (F.col("p_partkey") % len(POINTERS) + 1).cast("int"))
    t = F.replace(t, F.lit("{i}"), F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", grammar.pointer_issue(t).alias("issue"))


CODE = "lpad(to_base({} % 1296, 36), 2, '0')"


@query(
    "selection_roundtrip",
    f"""SELECT l_orderkey, l_linenumber, concat('T', {CODE.format("l_partkey")}, CASE WHEN l_linenumber % 3 = 0 THEN ' P-- U-- Q-- K-- SE'
      WHEN l_linenumber % 3 = 1 THEN concat(' P', {CODE.format("l_suppkey")}, ' U-- Q', {CODE.format("l_linenumber")}, ' K-- SC')
      ELSE concat(' P-- U', {CODE.format("l_suppkey")}, ' Q-- K-- SC') END) AS line, CAST(NULL AS VARCHAR) AS issue FROM lineitem""",
)
def selection_roundtrip(spark, sf_dir):
    """Selections written from codes and read again without an issue."""
    code, k = (lambda c: text.base36(F.col(c) % 1296)), F.col("l_linenumber") % 3
    line = grammar.serialize_selection(
        code("l_partkey"), F.when(k == 1, code("l_suppkey")), F.when(k == 2, code("l_suppkey")), F.when(k == 1, code("l_linenumber")),
        F.lit(None).cast("string"), F.when(k == 0, "insufficient-evidence").otherwise("comparable"),
    )
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", line.alias("line"))
    return rows.withColumn("issue", grammar.selection_issue(F.col("line")))


@query(
    "near_rates",
    """SELECT l_orderkey, l_linenumber, abs(l_extendedprice / 1000 - l_extendedprice / (1000 + l_linenumber * 0.02)) <=
      greatest(0.001, abs(l_extendedprice / (1000 + l_linenumber * 0.02)) * 0.0001) AS near FROM lineitem""",
)
def near_rates(spark, sf_dir):
    """Rates that are equal for practical purposes."""
    p = F.col("l_extendedprice")
    near = grammar.approximately_equal(p / 1000, p / (1000 + F.col("l_linenumber") * 0.02))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", near.alias("near"))

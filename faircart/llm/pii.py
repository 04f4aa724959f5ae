"""Personal data in text: pattern spans, and terms that give protected entities away.

DataFrame functions only. E-mail addresses, IP addresses, card and phone numbers are found with
their places. Protected entities are the values themselves and the groups they belong to (mail domain,
network, card issuer, dialling prefix), so that a value that stands once is protected with its group.
A term that stands in a text with an entity discloses the share ``PMI(entity, term) / IC(entity)`` of it,
with pointwise mutual information and information content estimated from row counts over the whole
corpus; 1 means that the term names the entity as surely as the entity itself. Rare pairs are
discounted by ``m/(m+1) * k/(k+1)``, where ``m`` distinct texts hold both and ``k`` rows the rarer of the two.
Terms above one threshold are generalised, above a higher one removed, wherever they stand in a text
that holds the entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

#: Patterns by kind, in the order of the results. The possessive and bounded forms match what
#: the plain ones do, leftmost and without overlap, but in linear time and bounded stack: a start
#: inside a run can only succeed where the run's own start does, or right after a match.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Whole runs of 13 to 19 digits; longer and shorter runs can't pass and are skipped.
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "term")
TERM = r"\p{L}{3,}+"
SPAN = "array<struct<kind:int,start:int,end:int,value:string>>"
#: Kinds of entities: the four kinds of values, then their groups.
GROUPED = 10
GENERALISE, REMOVE = 0.5, 0.75


def located(text: Column, pattern: str | Column, kind: int) -> Column:
    """All matches with code point places, from the pieces between them."""
    if isinstance(pattern, str):
        pattern = F.lit(pattern)
    matches, pieces = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(pieces, 1, F.size(matches)), matches, lambda a, b: F.struct(F.length(a).alias("gap"), b.alias("value")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc, x):
        start = acc.at + x.gap
        end = start + F.length(x.value)
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x.value.alias("value"))
        return F.struct(end.alias("at"), F.concat(acc.out, F.array(span)).alias("out"))

    return F.aggregate(pairs, zero, step, lambda acc: acc.out)


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """The Luhn check over a string of digits."""
    each = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def byte_part(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+", "")
    return (F.length(bare) <= 3) & (F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255)


def base_spans(text: Column) -> Column:
    """Spans of the four pattern kinds, ordered by kind and then by start; ``text`` must not be null."""
    none = F.array().cast(SPAN)
    card = lambda s: luhn(digits(s.value))
    phone = lambda s: F.length(digits(s.value)).between(9, 15)
    return F.concat(
        F.when(F.contains(text, F.lit("@")), located(text, EMAIL, 0)).otherwise(none),
        F.when(text.rlike(IP), F.filter(located(text, IP, 1), lambda s: F.forall(F.split(s.value, r"\."), byte_part))).otherwise(none),
        F.when(text.rlike(CARD), F.filter(located(text, CARD, 2), card)).otherwise(none),
        F.when(F.contains(text, F.lit("+")), F.filter(located(text, PHONE, 3), phone)).otherwise(none),
    )


def entities(spans: Column) -> Column:
    """Distinct protected entities of a text: each value, and the group it belongs to."""

    def of(s):
        bare = F.when(s["kind"].isin(2, 3), digits(s["value"])).otherwise(F.lower(s["value"]))
        group = (
            F.when(s["kind"] == 0, F.substring_index(bare, "@", -1))
            .when(s["kind"] == 1, F.substring_index(bare, ".", 2))
            .when(s["kind"] == 2, F.substring(bare, 1, 6))
            .otherwise(F.substring(bare, 1, 4))
        )
        value = F.struct(s["kind"].alias("kind"), bare.alias("entity"))
        return F.array(value, F.struct((s["kind"] + GROUPED).alias("kind"), group.alias("entity")))

    return F.array_distinct(F.flatten(F.transform(spans, of)))


def terms_of(text: Column) -> Column:
    """Distinct terms of a text, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def text_key(text: Column) -> Column:
    """The key that equal texts share: their SHA-256, so that no text gets another's spans."""
    return F.unhex(F.sha2(text.cast("binary"), 256)).alias("key")


def term_counts(rows: DataFrame) -> DataFrame:
    """``(term, n_t)``: in how many rows of ``rows(text)`` each term stands, over all rows and terms."""
    return rows.select(F.explode(terms_of(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))


def disclosure(total: int) -> Column:
    """The discounted share of an entity that a term discloses, from counts of rows (``n_ct n_c n_t``) and texts.

    Null where the entity is in every row.
    """
    n = F.lit(float(total))
    share = F.try_divide(F.log2(n * F.col("n_ct") / (F.col("n_c") * F.col("n_t"))), F.log2(n / F.col("n_c")))
    k = F.least("n_c", "n_t")
    return share * (F.col("texts") / (F.col("texts") + 1)) * (k / (k + 1))


def disclosing_terms(held: DataFrame, counts: DataFrame, total: int, generalise: float, remove: float) -> DataFrame:
    """``(kind, entity, term, value)`` of all pairs that disclose enough.

    ``held(key, size, rows, ents, terms)`` has each distinct text with entities once, with its number of rows. The
    share cannot exceed ``log2(n/n_t) / log2(n/n_c)``, so a term too common for every entity leaves
    before pairs are formed, and one too common for its own entity before they are counted.
    """
    names = held.select("key", "size", "rows", F.explode("ents").alias("e")).select("key", "size", "rows", "e.*")
    known = names.groupBy("kind", "entity").agg(F.sum("rows").alias("n_c"))
    names = names.join(known, ["kind", "entity"])
    most = known.agg(F.max("n_c")).first()[0] or 0

    def able(n_t: Column, n_c: Column) -> Column:
        return F.log2(F.lit(float(total)) / n_t) >= generalise * F.log2(F.lit(float(total)) / n_c)

    rare = counts.where((F.col("n_t") > 1) & able(F.col("n_t"), F.lit(float(max(most, 1)))))
    terms = held.select("key", "size", F.explode("terms").alias("term")).join(rare, "term")
    pairs = terms.join(names, ["key", "size"]).where(able(F.col("n_t"), F.col("n_c")))
    pairs = pairs.groupBy("kind", "entity", "term", "n_t", "n_c").agg(F.sum("rows").alias("n_ct"), F.count("*").alias("texts"))
    told = pairs.withColumn("share", disclosure(total)).where(F.col("share") >= generalise)
    return told.select("kind", "entity", "term", F.when(F.col("share") >= remove, "remove").otherwise("generalise").alias("value"))


def locate(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE) -> tuple[DataFrame, DataFrame]:
    """``(found, terms)``: the base spans per row, and the disclosing terms' spans per distinct text.

    ``found(doc_id, key, size, spans)`` has every row of ``docs``. ``terms(key, size, terms)``
    has spans of kind ``term`` whose value is ``remove`` or ``generalise``.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = rows.select("doc_id", text_key(F.col("text")), F.length("text").alias("size"), "text", base_spans(F.col("text")).alias("spans"))
    # Texts are kept only where there is something to protect.
    found = materialise(found.withColumn("text", F.when(F.size("spans") > 0, F.col("text"))), "pii")
    total = found.count()
    texts = found.where("text is not null").groupBy("key", "size").agg(F.count("*").alias("rows"), F.min("text").alias("text"), F.first("spans").alias("spans"))
    texts = texts.select("key", "size", "rows", "text", "spans", entities(F.col("spans")).alias("ents"), terms_of(F.col("text")).alias("terms"))
    texts = materialise(texts, "pii-texts")
    told = materialise(disclosing_terms(texts, term_counts(rows), total, generalise, remove), "pii-told")

    names = texts.select("key", "size", F.explode("ents").alias("e")).select("key", "size", "e.*").join(told, ["kind", "entity"])
    names = names.groupBy("key", "size", "term").agg(F.max("value").alias("value"))
    own = texts.select("key", "size", F.explode("terms").alias("term"))
    hits = names.join(own, ["key", "size", "term"]).groupBy("key", "size").agg(F.map_from_entries(F.collect_list(F.struct("term", "value"))).alias("told"))
    hits = hits.join(texts.select("key", "size", "text", "spans"), ["key", "size"])
    # Only the told terms are located, as whole runs of letters.
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.sort_array(F.map_keys("told"), False), "|"), F.lit(r")(?!\p{L})"))
    hits = hits.withColumn("pattern", pattern)

    def span(t):
        value = F.try_element_at(F.col("told"), F.lower(t["value"]))
        return F.struct(t["kind"].alias("kind"), t["start"].alias("start"), t["end"].alias("end"), value.alias("value"))

    places = F.transform(located(F.col("text"), F.col("pattern"), 4), span)
    free = F.filter(places, lambda t: t["value"].isNotNull() & ~F.exists("spans", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    return found.drop("text"), materialise(hits.select("key", "size", free.alias("terms")), "pii-terms")


def with_terms(found: DataFrame, terms: DataFrame) -> DataFrame:
    """``found`` with all spans of each row, base spans first."""
    joined = found.join(terms, ["key", "size"], "left")
    return joined.select(*found.columns, F.concat("spans", F.coalesce("terms", F.array().cast(SPAN))).alias("all"))


def listing(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s.kind], s.start, s.end)), ",")


def find(docs: DataFrame, **options) -> DataFrame:
    """Spans per row of ``docs(doc_id, text)``.

    Returns ``(doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans)``. A null text is
    empty; a text without spans has zero counts and the digest of nothing. Repeated rows and null
    ids keep their rows, other columns are ignored, an empty table gives no rows.
    """
    out = with_terms(*locate(docs, **options))

    def of_kind(k: int) -> Column:
        return F.size(F.filter("all", lambda s: s.kind == k)).cast("long").alias(f"n_{KINDS[k]}")

    counts = [of_kind(k) for k in range(len(KINDS))]
    digest = F.sha2(listing(F.col("spans")).cast("binary"), 256).alias("base_sha256")
    return out.select("doc_id", *counts, digest, listing(F.col("all")).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its mark; of overlapping spans the first to start gives the mark."""
    marks = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s.start.alias("start"), (-s.end).alias("last"), s.kind.alias("kind"), s.value.alias("value"))))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        mark = F.when((s.kind == 4) & (s.value == "remove"), "").otherwise(marks[s.kind])
        kept = F.substring(text, acc.at + 1, s.start - acc.at)
        return F.when(
            s.start >= acc.at, F.struct((-s.last).alias("at"), F.concat(acc.out, F.array(kept, mark)).alias("out"))
        ).otherwise(F.struct(F.greatest(acc.at, -s.last).alias("at"), acc.out.alias("out")))

    def close(acc):
        return F.array_join(F.concat(acc.out, F.array(F.substring(text, acc.at + 1, F.length(text)))), "")

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(ordered, zero, step, close))


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """``docs``, all rows and columns kept, with spans in ``text`` replaced, generalised or removed.

    Null texts stay null and empty ones empty; repeated rows and null ids are treated like any others; an empty
    table gives no rows. Names of further columns may be anything. Only texts with spans are joined to them.
    """
    found, terms = locate(docs, **options)
    spans = with_terms(found.where(F.size("spans") > 0).select("key", "size", "spans").dropDuplicates(["key", "size"]), terms)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), text_key(text), F.length(text).alias("size"))
    joined = rows.join(spans.select("key", "size", "all"), ["key", "size"], "left")
    new = F.when(F.col("all").isNull(), F.col("row.text")).otherwise(redacted(F.col("row.text"), F.col("all")))
    return joined.select(*(new.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms in all ``documents``."""
    return find(table(spark, sf_dir, "documents"))

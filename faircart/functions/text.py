"""Text and number helpers with browser-script semantics, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space beyond ASCII that browser scripts' \\s takes in and Java's does not.
WIDE_SPACE = "                 　﻿"


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with underscores before it until no column of ``df`` has it (case ignored)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def ascii_words(pattern: str) -> str:
    """A pattern whose word boundaries know ASCII letters, digits and _ only, whatever the JVM."""
    return pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")


def ci(pattern: str) -> str:
    """The same, ignoring case."""
    return "(?i)" + ascii_words(pattern)


def matches(text: Column, pattern: str) -> Column:
    """Whether ``pattern`` stands anywhere in ``text``, ignoring case."""
    return text.rlike(ci(pattern))


def plain_space(text: Column) -> Column:
    """Every kind of white space as an ASCII blank; do this once, at ingest."""
    return F.translate(text, WIDE_SPACE, " " * len(WIDE_SPACE))


def squeeze(text: Column) -> Column:
    """Runs of white space to one blank, none at the ends."""
    return F.trim(F.regexp_replace(plain_space(text), r"\s+", " "))


def once(df: DataFrame, **made: Column) -> DataFrame:
    """``df`` with the columns of ``made``, computed once for each row, whoever reads them.

    Filters on a plain column compute its expression again, each on its own; those on an exploded one can't.
    """
    name = free_name(df, "_made")
    held = F.struct(*(c.alias(k) for k, c in made.items()))
    return df.withColumn(name, F.explode(F.array(held))).select("*", f"{name}.*").drop(name)


#: A control character that marks the places of matches.
CUT = "\x01"
#: Fixed value: what may follow a unit.
AHEAD = ascii_words(r"(?=\b|\W)")


def let(value: Column, body) -> Column:
    """``body(x)`` with ``x`` bound to ``value``, which is computed once however often ``x`` is used.

    Expressions inside a lambda are else computed again for each element.
    """
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def find_all(text: Column, pattern: str) -> Column:
    """All matches left to right: ``array<struct<start, end, value>>``, in characters from 0.

    The pieces between matches give the places, so no Python runs.
    """
    kind = "array<struct<start:int,end:int,value:string>>"
    # Splitting by the pattern itself would compile it anew for every row; replacing keeps it.
    text = F.translate(text, CUT, " ")
    pieces = F.split(F.regexp_replace(text, pattern, CUT), CUT, -1)

    def pairs(found):
        return F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda a, b: F.struct(F.length(a).alias("gap"), b.alias("value")))

    pairs = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), pairs)

    def step(acc, x):
        start = acc.at + x.gap
        end = start + F.length(x.value)
        span = F.struct(start.alias("start"), end.alias("end"), x.value.alias("value"))
        return F.struct(end.alias("at"), F.concat(acc.out, F.array(span)).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
    return F.when(text.rlike(pattern), F.aggregate(pairs, zero, step, lambda a: a.out)).otherwise(F.array().cast(kind))


def group(value: Column, pattern: str, n: int) -> Column:
    """Group ``n`` of a whole match of ``pattern``; null where it took no part.

    A look at what follows the match is left out, as nothing does here.
    """
    got = F.regexp_extract(value, f"^(?:{pattern.replace(AHEAD, '')})$", n)
    return F.when(got != "", got)


def js_round(x: Column) -> Column:
    """Half up toward plus infinity."""
    return F.floor(x + 0.5)


def to_fixed(x: Column, digits: int) -> Column:
    """Fixed decimals of the exact binary value, exact ties up (``digits`` 0 to 2, ``x`` >= 0).

    ``format_number`` rounds the exact value half to even; only exact ties differ, and those are
    odd multiples of 1/2, 1/4 or 1/8.
    """
    pattern = "0" if digits == 0 else "0." + "0" * digits
    scale = 2 ** (digits + 1)
    scaled = x * scale
    tie = (scaled == F.floor(scaled)) & (F.pmod(F.floor(scaled), F.lit(2)) == 1)
    up = (F.floor(x * 10**digits) + 1) / 10**digits
    return F.call_function("format_number", F.when(tie, up).otherwise(x), F.lit(pattern))


def trim_zeros(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\.0+$", ""), r"(\.\d*?)0+$", "$1")


def number_text(x: Column) -> Column:
    """A double the way scripts print it: no decimals for whole numbers."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def slugify(text: Column) -> Column:
    dashed = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, 80)


def base36(index: Column) -> Column:
    """0..1295 as two upper-case digits; null outside."""
    return F.when(index.between(0, 1295), F.lpad(F.conv(index.cast("string"), 10, 36), 2, "0"))


def hash_text(text: Column) -> Column:
    """31-multiplier hash of the characters in 32 bits, its absolute value in base 36."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    codes = F.when(text == "", F.array().cast("array<long>")).otherwise(codes)
    h = F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: (a * 31 + c).bitwiseAND(F.lit(0xFFFFFFFF)))
    signed = F.when(h >= 2**31, h - 2**32).otherwise(h)
    return F.lower(F.conv(F.abs(signed).cast("string"), 10, 36))


def normalize_coordinate(value: Column, size: Column) -> Column:
    """Thousandths of ``size``, 0 where it makes no sense."""
    return F.when((size > 0) & ~F.isnan(value) & ~F.isnan(size), js_round(value / size * 1000)).otherwise(0).cast("long")


def squeezed_alnum(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


#: Compatibility forms of ASCII characters: the full-width block and the ideographic blank.
FULL_WIDTH = "".join(map(chr, range(0xFF01, 0xFF5F))) + "\u3000"
HALF_WIDTH = "".join(map(chr, range(0x21, 0x7F))) + " "


def title_hash(text: Column) -> Column:
    """sha256 of the lower-case letters and digits of a whole text, for duplicate titles.

    Compatibility forms of ASCII characters are brought back first; other characters are no letters here anyway.
    """
    return F.sha2(squeezed_alnum(F.translate(text, FULL_WIDTH, HALF_WIDTH)), 256)


def text_similarity(left: Column, right: Column) -> Column:
    """1 if equal or contained, else the Dice coefficient of the word sets; 0 for no words."""
    a, b = squeezed_alnum(left), squeezed_alnum(right)
    return squeezed_similarity(a, word_set(a), b, word_set(b))


def word_set(squeezed: Column) -> Column:
    """Distinct words of a text that ``squeezed_alnum`` gave."""
    return F.array_distinct(F.split(squeezed, " "))


def squeezed_similarity(a: Column, x: Column, b: Column, y: Column) -> Column:
    """``text_similarity`` of two squeezed texts with their word sets, for pairs of texts that are each read once."""
    dice = F.size(F.array_intersect(x, y)) * 2 / (F.size(x) + F.size(y))
    return F.when((a == "") | (b == ""), 0.0).when(F.contains(a, b) | F.contains(b, a), 1.0).otherwise(dice)


def mostly_singular(token: Column) -> Column:
    """-ies to -y, and no final -s unless it is -ss."""
    cut = lambda n: F.substring(token, F.lit(1), F.length(token) - n)
    return (
        F.when((F.length(token) > 4) & token.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when((F.length(token) > 3) & token.endswith("s") & ~token.endswith("ss"), cut(1))
        .otherwise(token)
    )


#: Letters with marks and what compatibility decomposition and mark removal leave of them.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def search_tokens(text: Column) -> Column:
    """Search words: marks dropped, letters and digits, longer than one, singular by rule."""
    words = F.split(F.translate(F.lower(text), MARKED, PLAIN), "[^a-z0-9]+")
    return F.transform(F.filter(words, lambda w: F.length(w) > 1), mostly_singular)


# Words that queries ignore.
QUERY_STOP_WORDS = ("and", "or", "of", "the")


def query_tokens(text: Column) -> Column:
    """Distinct query words; marks split words here, and -es plurals lose both letters."""
    spread = F.translate(F.lower(text), MARKED, PLAIN)
    words = F.filter(F.split(spread, "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(*QUERY_STOP_WORDS))

    def singular(t):
        return F.when(
            (F.length(t) > 4) & ~t.endswith("ies") & t.rlike("(ches|shes|sses|xes|zes)$"), F.substring(t, F.lit(1), F.length(t) - 2)
        ).otherwise(mostly_singular(t))

    return F.array_distinct(F.transform(words, singular))


def query_coverage(query: Column, evidence: Column, stop: tuple[str, ...] = ("all", "and", "for", "of", "purpose", "the", "with")) -> Column:
    """Share of the query's words that the evidence holds; 1 for no words."""
    q = F.filter(search_tokens(query), lambda w: ~w.isin(*stop))
    e = search_tokens(evidence)
    hit = F.size(F.filter(q, lambda w: F.array_contains(e, w)))
    return F.when(F.size(q) == 0, 1.0).otherwise(hit / F.size(q))


def matches_query(text: Column, query: Column) -> Column:
    q = query_tokens(query)
    return (F.size(q) > 0) & (F.size(F.array_except(q, query_tokens(text))) == 0)


# What a challenge page says.
CHALLENGE = (
    r"\b(access (?:to (?:this|the) page (?:has been )?)?denied|verification required|verify you are human|captcha|robot check|"
    r"robot or human|unusual traffic|activate and hold|secure your access)\b"
)


def is_bot_challenge(text: Column) -> Column:
    return matches(text, CHALLENGE)


def same_site(expected: Column, actual: Column) -> Column:
    """Equal hosts, or one a subdomain of the other."""
    a, b = (F.regexp_replace(F.lower(F.trim(c)), r"\.$", "") for c in (expected, actual))
    return (a == b) | F.endswith(a, F.concat(F.lit("."), b)) | F.endswith(b, F.concat(F.lit("."), a))


def sanitize_url(url: Column) -> Column:
    """Origin and path."""
    return F.regexp_extract(url, "^([a-zA-Z]+://[^/?#]+[^?#]*)", 1)


def page_type(path: Column) -> Column:
    """Kind of page by its path; the first rule that fits."""
    return (
        F.when(path.rlike(r"(?i)/(?:ip|dp|p|product)/"), "product")
        .when(path.rlike("(?i)cart|checkout"), "cart")
        .when(path.rlike(r"(?i)search|s\?|browse|category|cat"), "search")
        .otherwise("unknown")
    )


# Reasons for rejection and what they say about another attempt.
RECOVERABLE = (
    (r"passed screening|passed the (desktop|narrow)|coherent", 6),
    (r"complete query|candidate|product root", 2),
    (r"obstruction|annotation|clipp|displaced", 2),
    (r"404|route|search|query evidence", 2),
    (r"timeout|bound|deadline", 1),
    (r"bot challenge|HTTP 403|DNS|redirected to Google|different registrable domain", -5),
)


def recoverability(reason: Column) -> Column:
    return sum((F.when(matches(reason, p), w).otherwise(0) for p, w in RECOVERABLE), F.lit(0))


def evidence_signature(canonical: Column) -> Column:
    """Group key of equal evidence: the first 20 hex digits of its sha256."""
    return F.substring(F.sha2(canonical, 256), 1, 20)


# Answers of the review model.
DECISIONS = {
    "VALID": ("valid", "valid"),
    "INVALID_PRODUCT_SPEC": ("invalid", "product-specification"),
    "INVALID_UNRELATED_ATTRIBUTE": ("invalid", "unrelated-attribute"),
    "INVALID_EVIDENCE_MISMATCH": ("invalid", "evidence-mismatch"),
    "UNCERTAIN": ("uncertain", "insufficient-context"),
}


def parse_decision(raw: Column) -> Column:
    """``struct<decision, reason>``; anything but a known answer is uncertain."""
    answer = F.upper(F.trim(raw))
    out = F.struct(F.lit("uncertain").alias("decision"), F.lit("invalid-model-response").alias("reason"))
    for text, (decision, reason) in DECISIONS.items():
        known = F.struct(F.lit(decision).alias("decision"), F.lit(reason).alias("reason"))
        out = F.when(answer == text, known).otherwise(out)
    return out


def strict_json(text: Column) -> Column:
    """Parsed VARIANT, null if the text is not one JSON value and nothing else (the parser alone takes what follows a value)."""
    return F.when(F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1, F.try_parse_json(text))

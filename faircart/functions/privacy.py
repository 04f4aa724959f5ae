"""Personal data in captured text and URLs: redaction, labels and findings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_words, ci

# What is redacted, in this order; the last three words of a mark name the kind.
EMAIL = r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PHONE = r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}\b"
ADDRESS = (
    r"\b\d{1,6}[ \t]+(?:[NSEW]\.?[ \t]+)?[A-Z0-9][A-Za-z0-9.' -]{1,60}[ \t]+"
    r"(?:street|st|road|rd|avenue|ave|boulevard|blvd|drive|dr|lane|ln|court|ct|way|place|pl)\b"
)
GREETING = r"\b(?:hi|hello|welcome back),?\s+[A-Z][a-z]{1,30}\b"
CREDENTIAL = (
    r"\b(?:bearer\s+[A-Za-z0-9._~+/=-]{16,}|(?:api[-_]?key|access[-_]?token|session[-_]?id)\s*[:=]\s*[A-Za-z0-9._~+/=-]{12,})\b"
)
REDACTED = (("email", EMAIL, "EMAIL"), ("phone", PHONE, "PHONE"), ("street-address", ADDRESS, "ADDRESS"), ("account-greeting", GREETING, "ACCOUNT"), ("credential", CREDENTIAL, "CREDENTIAL"))
# Labels of what must not be published; the flag says whether case counts.
SENSITIVE = (
    ("URL", r"\bhttps?://[^\s\"'<>]+", False),
    ("email address", EMAIL, False),
    ("Hugging Face token", r"\bhf_[A-Za-z0-9]{20,}\b", True),
    ("API key", r"\b(?:ak|sk)-[A-Za-z0-9_-]{16,}\b", True),
    ("bearer token", r"\bBearer\s+[A-Za-z0-9._~+/-]{16,}", False),
    ("private key", r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----", True),
    ("cookie header", r"\b(?:set-cookie|cookie):\s*[^;\n]+", False),
)
# Fixed value: names of URL parameters that tell about a person.
SENSITIVE_KEY = r"^(?:access_token|auth|authorization|code|cookie|email|session|sid|token|user|userid|customer|address|postal|zip)$"


def redact(text: Column) -> Column:
    """``text`` with each kind of personal data replaced by its mark."""
    for _, pattern, mark in REDACTED:
        text = F.regexp_replace(text, ci(pattern), f"[REDACTED {mark}]")
    return text


def sensitive_labels(text: Column) -> Column:
    """The sorted labels of what stands in a text that must not be published."""
    found = (F.when(text.rlike(ascii_words(p) if cased else ci(p)), label) for label, p, cased in SENSITIVE)
    return F.array_sort(F.array_compact(F.array(*found)))


def text_findings(text: Column) -> Column:
    """The categories of personal data that a text holds, in the order of redaction."""
    return F.array_compact(F.array(*(F.when(text.rlike(ci(p)), category) for category, p, _ in REDACTED)))


def url_has_sensitive_key(url: Column) -> Column:
    """Whether a query parameter of the URL is named like personal data."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return F.exists(F.split(query, "&"), lambda p: F.split(p, "=")[0].rlike("(?i)" + SENSITIVE_KEY))

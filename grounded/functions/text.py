"""Column-level text functions (JVM side, inside whole-stage codegen where possible).

Patterns are written so that Java regex (Spark) and RE2 (the SQL oracle) give the
same matches: explicit whitespace classes instead of ``\\s``, no ``\\b``, no look-around.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -----------------------------------------------------------
# Token = maximal run of non-whitespace (space, tab, newline, carriage return, form feed).
TOKEN_PATTERN = r"[^ \t\n\r\f]+"
# Whitespace trimmed like Go's TrimSpace (ASCII space set plus NEL and NBSP).
TRIM_PATTERN = r"^[ \t\n\x0B\f\r\x{85}\x{A0}]+|[ \t\n\x0B\f\r\x{85}\x{A0}]+$"
WS_RUN_PATTERN = r"[ \t\n\x0B\f\r\x{85}\x{A0}]+"
# Reasoning block emitted by the main model.
THINK_PATTERN = r"(?s)<think>(.*?)</think>"
# HTML to text: blocks removed whole, then comments, then tags.
HTML_SCRIPT_PATTERN = r"(?is)<script[^>]*>.*?</script>"
HTML_STYLE_PATTERN = r"(?is)<style[^>]*>.*?</style>"
HTML_COMMENT_PATTERN = r"(?s)<!--.*?-->"
HTML_TAG_PATTERN = r"<[^>]*>"
# Entities decoded in this order; &amp; last so "&amp;lt;" stays "&lt;".
HTML_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "),
                 ("&amp;", "&")]
# Personal data and secrets (policy group "privacy").
PII_PATTERNS = [
    ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("CARD", r"(^|[^0-9])[0-9]{16}([^0-9]|$)"),
    ("PHONE", r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}"),
    ("IP", r"(^|[^0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}([^0-9.]|$)"),
    ("SECRET", r"(?i)(token|secret|password|api_key|apikey)[ ]*[=:][ ]*\"?[A-Za-z0-9_-]{16,}"),
]
# ------------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def tokens(col, lower: bool = False) -> Column:
    c = _c(col)
    if lower:
        c = F.lower(c)
    return F.regexp_extract_all(c, F.lit(TOKEN_PATTERN), 0)


def go_trim(col) -> Column:
    return F.regexp_replace(_c(col), TRIM_PATTERN, "")


def byte_length(col) -> Column:
    return F.octet_length(_c(col))


def strip_think(col) -> Column:
    """Remove every non-greedy reasoning block, then trim."""
    return go_trim(F.regexp_replace(_c(col), THINK_PATTERN, ""))


def think_body(col) -> Column:
    """First reasoning block body, trimmed, newlines flattened; NULL without one."""
    c = _c(col)
    body = F.regexp_replace(go_trim(F.regexp_extract(c, THINK_PATTERN, 1)), "\n", " ")
    return F.when(c.rlike(THINK_PATTERN), body)


def strip_newlines(col) -> Column:
    return F.regexp_replace(_c(col), "\n", " ")


def html_to_text(col) -> Column:
    c = _c(col)
    for pat in (HTML_SCRIPT_PATTERN, HTML_STYLE_PATTERN, HTML_COMMENT_PATTERN, HTML_TAG_PATTERN):
        c = F.regexp_replace(c, pat, " ")
    for ent, rep in HTML_ENTITIES:
        c = F.replace(c, F.lit(ent), F.lit(rep))
    return go_trim(F.regexp_replace(c, WS_RUN_PATTERN, " "))


def hash_bucket(tok: Column, dim: int) -> Column:
    """Stand-in embedder bucket: first 8 hex digits of md5(token) mod dim."""
    return (F.conv(F.substring(F.md5(tok), 1, 8), 16, 10).cast("bigint") % F.lit(dim)).cast("int")


def token_buckets(col, dim: int) -> Column:
    """Array of hashed buckets of the lower-cased tokens of a text (JVM side)."""
    return F.transform(tokens(col, lower=True), lambda t: hash_bucket(t, dim))


def pii_categories(col) -> Column:
    c = _c(col)
    return F.array_compact(F.array(*[F.when(c.rlike(p), F.lit(name)) for name, p in PII_PATTERNS]))

"""Message normalisation functions, built from Spark's regex functions.

Each function takes a column name (or any Spark SQL expression text) and
returns a Column.  The expression is written once as Spark SQL and parsed
JVM-side in one call, which keeps plan construction cheap even for the long
regex chains; evaluation is whole-stage code-generated like any built-in.
Nothing runs in Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: regular expressions of the error-pattern normaliser, applied in this order
ERROR_PATTERN_RULES = (
    (r"\b\d+\b", "NUM"),
    (r"\b[0-9a-fA-F]{8,}\b", "ID"),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "IP"),
    (r"\b\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}", "TIMESTAMP"),
    (r"/[a-zA-Z0-9/_-]+", "/PATH"),
)

# fixed values: regular expressions of the message-signature normaliser, applied in this order
SIGNATURE_RULES = (
    (r"\d+", "NUM"),
    (r"\b[a-f0-9]{8,}\b", "HASH"),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "IP"),
    (r"/[a-zA-Z0-9/_-]+", "/PATH"),
)

# fixed values: stop words dropped from message signatures
SIGNATURE_STOP_WORDS = ("the", "and", "for", "with", "from", "that", "this")

# fixed values: stop words dropped from frequent terms
TERM_STOP_WORDS = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for",
                   "of", "with", "by", "is", "was", "are", "were", "be", "been", "being")

# fixed values: response-time patterns (case-insensitive), tried in this order
RESPONSE_TIME_PATTERNS = (
    r"took (\d+\.?\d*)ms",
    r"duration:?\s*(\d+\.?\d*)s",
    r"(\d+\.?\d*)ms",
    r"time=(\d+\.?\d*)ms",
)

NUMBER = r"\d+\.?\d*"
WORD3 = r"\b[a-zA-Z]{3,}\b"
WORD4 = r"\b[a-zA-Z]{4,}\b"


def lit_raw(s: str) -> str:
    """Spark SQL raw string literal (backslashes kept as written)."""
    if "'" in s:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return "r'" + s + "'"


def _str_array(words) -> str:
    return "array(" + ", ".join(lit_raw(w) for w in words) + ")"


def _text(m: str) -> str:
    return f"coalesce({m}, '')"


def _chain(expr: str, rules) -> str:
    for pat, rep in rules:
        expr = f"regexp_replace({expr}, {lit_raw(pat)}, {lit_raw(rep)})"
    return expr


def strip_sql(expr: str) -> str:
    """Remove leading/trailing whitespace of any kind (not only blanks)."""
    return f"regexp_replace({expr}, r'^\\s+|\\s+$', '')"


def error_pattern_sql(m: str = "message") -> str:
    return strip_sql(_chain(_text(m), ERROR_PATTERN_RULES))


def message_signature_sql(m: str = "message") -> str:
    norm = _chain(f"lower({_text(m)})", SIGNATURE_RULES)
    words = f"regexp_extract_all({norm}, {lit_raw(WORD3)}, 0)"
    kept = f"filter({words}, w -> NOT array_contains({_str_array(SIGNATURE_STOP_WORDS)}, w))"
    return f"array_join(slice({kept}, 1, 5), ' ')"


def cluster_signature_sql(m: str = "message") -> str:
    words = f"regexp_extract_all(lower({_text(m)}), {lit_raw(WORD4)}, 0)"
    return f"array_join(slice(array_sort(array_distinct({words})), 1, 3), ' ')"


def terms_sql(m: str = "message") -> str:
    words = f"regexp_extract_all(lower({_text(m)}), {lit_raw(WORD3)}, 0)"
    return f"filter({words}, w -> NOT array_contains({_str_array(TERM_STOP_WORDS)}, w))"


def response_time_sql(m: str = "message", unit_mode: str = "intended") -> str:
    if unit_mode not in ("intended", "reference"):
        raise ValueError(f"unknown unit_mode {unit_mode!r}")
    parts = []
    for pat in RESPONSE_TIME_PATTERNS:
        scale = 1000.0 if (unit_mode == "reference" or "duration" in pat) else 1.0
        # regexp_substr is null when the pattern does not occur; the number is
        # then read from the short matched text (it is the pattern's only group),
        # so the cast never sees an empty string and nothing is evaluated twice
        whole = pat.replace("(", "").replace(")", "")
        hit = f"regexp_substr({_text(m)}, {lit_raw('(?i)' + whole)})"
        parts.append(f"CAST(regexp_extract({hit}, {lit_raw(NUMBER)}, 0) AS DOUBLE) * {scale}")
    return f"nullif(coalesce({', '.join(parts)}), 0.0)"


def error_pattern(m: str = "message") -> Column:
    """Generalised error pattern: numbers, hex ids and paths replaced; '' for empty."""
    return F.expr(error_pattern_sql(m))


def message_signature(m: str = "message") -> Column:
    """First five key words of the lower-cased, placeholder-substituted message."""
    return F.expr(message_signature_sql(m))


def cluster_signature(m: str = "message") -> Column:
    """First three of the sorted distinct 4+-letter words (may be '')."""
    return F.expr(cluster_signature_sql(m))


def terms(m: str = "message") -> Column:
    """Array of 3+-letter lower-case words without stop words."""
    return F.expr(terms_sql(m))


def response_time(m: str = "message", unit_mode: str = "intended") -> Column:
    """Milliseconds taken from the first matching pattern; null when none or 0.

    unit_mode='intended' scales only the seconds pattern by 1000;
    unit_mode='reference' scales every pattern by 1000 (the original service's
    behaviour, whose unit test is true for all four patterns).
    """
    return F.expr(response_time_sql(m, unit_mode))


def strip(m: str) -> Column:
    return F.expr(strip_sql(m))


def truncate(m: str = "message", n: int = 100) -> Column:
    return F.expr(f"substring({_text(m)}, 1, {int(n)})")

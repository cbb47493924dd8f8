r"""The values that the oracles' SQL rests on, written out a second time.

The oracles import nothing from the engine for them, so that a wrong
pattern, word or phrase there shows as a difference.
"""

from __future__ import annotations

# fixed values: message normalisation of error patterns
ERROR_PATTERN_RULES = (
    (r"\b\d+\b", "NUM"),
    (r"\b[0-9a-fA-F]{8,}\b", "ID"),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "IP"),
    (r"\b\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}", "TIMESTAMP"),
    (r"/[a-zA-Z0-9/_-]+", "/PATH"),
)
# fixed values: timings in messages
RESPONSE_TIME_PATTERNS = (
    r"took (\d+\.?\d*)ms",
    r"duration:?\s*(\d+\.?\d*)s",
    r"(\d+\.?\d*)ms",
    r"time=(\d+\.?\d*)ms",
)
# fixed values: message signatures
SIGNATURE_RULES = (
    (r"\d+", "NUM"),
    (r"\b[a-f0-9]{8,}\b", "HASH"),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "IP"),
    (r"/[a-zA-Z0-9/_-]+", "/PATH"),
)
SIGNATURE_STOP_WORDS = ("the", "and", "for", "with", "from", "that", "this")
# fixed values: words that are not terms
TERM_STOP_WORDS = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by",
                   "is", "was", "are", "were", "be", "been", "being")
# fixed values: security phrases
SECURITY_RULES = {
    "failed_login": ("failed login", "authentication failed", "invalid credentials", "login denied"),
    "access_violation": ("access denied", "unauthorized", "forbidden", "permission denied"),
    "suspicious": ("brute force", "multiple attempts", "unusual activity", "security alert"),
    "injection": ("sql injection", "xss", "script injection", "code injection"),
}
# fixed value: time stamps of ingested entries (upper-case T and Z only)
RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
# fixed value: characters of a path that needs no encoding
PATH_SAFE = r"[A-Za-z0-9\-._~!$&'()*+,;=:@/]*"

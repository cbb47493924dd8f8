"""Security event detection by case-insensitive substring rules.

The rules are four event types with four phrases each.  They are evaluated
as OR-ed ``contains`` predicates in a single pass (no join, no shuffle); a log
hits each type at most once but may hit several types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.normalize import normalize_logs

# fixed values: security phrases per event type, matched against the lower-cased message
SECURITY_RULES = {
    "failed_login": ("failed login", "authentication failed", "invalid credentials", "login denied"),
    "access_violation": ("access denied", "unauthorized", "forbidden", "permission denied"),
    "suspicious": ("brute force", "multiple attempts", "unusual activity", "security alert"),
    "injection": ("sql injection", "xss", "script injection", "code injection"),
}
THREAT_TYPES = ("suspicious", "injection")


def security_events(df: DataFrame, rules: dict = SECURITY_RULES) -> DataFrame:
    """One row per (log, event type) hit.  Threats carry a severity: high
    when the log itself is error/fatal, else medium."""
    n = normalize_logs(df)
    low = F.lower(F.col("message"))
    hits = []
    for etype, phrases in rules.items():
        cond = None
        for p in phrases:
            c = low.contains(p)
            cond = c if cond is None else (cond | c)
        hits.append(F.when(cond, F.lit(etype)))
    typed = n.select("id", "log_ts", "source", "level", "message",
                     F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("event_type"))
    sev = F.when(F.col("event_type").isin(*THREAT_TYPES),
                 F.when(F.col("level").isin("error", "fatal"), "high").otherwise("medium"))
    return typed.select("id", "log_ts", "source", "event_type", sev.alias("severity"),
                        X.truncate("message").alias("message"))


def security_event_counts(df: DataFrame) -> DataFrame:
    return security_events(df).groupBy("event_type").agg(F.count(F.lit(1)).alias("count"))


def security_summary(df: DataFrame) -> DataFrame:
    """One row: failed logins, access violations, threats, score max(0, 100 - 5 * events)."""
    ev = security_events(df)
    t = F.col("event_type")
    return ev.agg(
        F.count(F.when(t == "failed_login", 1)).alias("failed_logins"),
        F.count(F.when(t == "access_violation", 1)).alias("access_violations"),
        F.count(F.when(t.isin(*THREAT_TYPES), 1)).alias("threats_detected"),
        F.count(F.lit(1)).alias("total_security_events"),
    ).select("*", F.greatest(F.lit(0), 100 - 5 * F.col("total_security_events")).cast("bigint")
             .alias("security_score"))

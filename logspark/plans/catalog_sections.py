"""The composed analyses as registered queries, and the report in flat form."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import report as RP
from . import sections as SE
from .catalog import ORACLE as _ORACLE
from .catalog import _logs, register

# Which single query each section of a composed analysis repeats.
QUERY = {"common_terms": "frequent_terms", "error_trends": "error_trend", "errors_by_hour": "error_time_distribution",
         "error_rate_anomalies": "high_error_rate_sources", "error_pattern_anomalies": "frequent_error_patterns",
         "throughput": "counts_by_source", "security_events": "security_event_counts", "ml_anomalies": "merged_anomalies"}


def _long_sql(parts) -> str:
    rows = []
    for name, items, numbers in parts:
        item = " || ' | ' || ".join(f"CAST({c} AS VARCHAR)" for c in items) or "'all'"
        for c in numbers:
            rows.append(f"SELECT '{name}' AS section, {item} AS item, '{c}' AS metric, CAST({c} AS DOUBLE) AS value "
                        f"FROM ({_ORACLE[QUERY.get(name, name)]}) part")
    return "\nUNION ALL ".join(rows)


@register("detect_patterns", _long_sql(SE.PATTERNS))
def _detect_patterns(spark, d):
    return SE.detect_patterns(_logs(spark, d))


@register("log_trends", _long_sql(SE.TRENDS))
def _log_trends(spark, d):
    return SE.log_trends(_logs(spark, d))


@register("report_sections", _long_sql(SE.REPORT + SE.PATTERNS + SE.TRENDS))
def _report_sections(spark, d):
    return SE.report_sections(_logs(spark, d))


_FLAT = {
    "summary": ("report_summary", ("total_logs_analyzed", "time_range", "health_status", "error_count",
                                   "most_active_source", "peak_activity_hour")),
    "error_analysis": ("error_frequency", ("total_errors", "error_rate", "severity_score")),
    "reliability_score": ("reliability_score", ("score", "grade")),
    "performance_analysis": ("performance_summary", ("timed_operations", "average_response_time", "slow_operations",
                                                     "performance_score")),
    "security_analysis": ("security_summary", ("failed_logins", "access_violations", "threats_detected",
                                               "total_security_events", "security_score")),
}
_COLUMNS = ", ".join(f"{name}.{c} AS {c}" for name, (_, columns) in _FLAT.items() for c in columns)
_TABLES = ", ".join(f"({_ORACLE[query]}) {name}" for name, (query, _) in _FLAT.items())


@register("report_overview", f"""SELECT {_COLUMNS},
 (SELECT count(*) FROM ({_ORACLE['high_error_rate_sources']}) a) + (SELECT count(*) FROM ({_ORACLE['frequent_error_patterns']}) b) AS anomalies,
 (SELECT count(*) FROM ({_ORACLE['alerts']}) c) AS alerts_raised,
 (SELECT string_agg(recommendation, chr(10) ORDER BY rank, recommendation) FROM ({_ORACLE['recommendations']}) r) AS recommendations
FROM {_TABLES}""")
def _report_overview(spark, d):
    """The one-row report, its numbers as plain columns."""
    out = RP.report(_logs(spark, d))
    flat = [F.col(f"{name}.{c}").alias(c) for name, (_, columns) in _FLAT.items() for c in columns]
    return out.select(*flat, F.col("anomaly_analysis.anomalies").alias("anomalies"), "alerts_raised",
                      F.array_join("recommendations", "\n").alias("recommendations"))


@register("report_text")
def _report_text(spark, d):
    """The command line's text view of the report."""
    return RP.render_text(_logs(spark, d), verbose=True)

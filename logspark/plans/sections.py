"""Composed analyses as long tables: (section, item, metric, value).

``detect_patterns``, ``log_trends`` and ``report_sections`` bring the row-shaped
parts of the comprehensive analysis together without packing them into
arrays of one row: each part is a frame of its operator, each number of a
row of it one row here.  A part that is empty adds no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..operators import anomalies as AN
from ..operators import errors as ER
from ..operators import ml as ML
from ..operators import patterns as PT
from ..operators import performance as PF
from ..operators import security as SC
from ..operators import trends as TR
from . import report as RP

# For each composed analysis its sections: name, the columns that name an
# item, the columns that hold its numbers.
PATTERNS = (
    ("common_terms", ("term",), ("count",)),
    ("error_signatures", ("pattern",), ("count",)),
    ("message_clusters", ("cluster",), ("count",)),
    ("temporal_patterns", ("hour", "level"), ("count",)),
    ("source_patterns", ("source", "level"), ("count",)),
)
TRENDS = (
    ("hourly_distribution", ("hour",), ("count",)),
    ("daily_distribution", ("day",), ("count",)),
    ("error_trends", ("hour",), ("total_logs", "error_count", "error_rate")),
    ("volume_statistics", (), ("mean", "median", "std_dev", "min", "max")),
    ("performance_indicators", (), ("avg_response_time", "median_response_time", "p95_response_time", "slow_requests")),
)
REPORT = (
    ("errors_by_level", ("level",), ("count",)),
    ("errors_by_source", ("source",), ("count",)),
    ("errors_by_hour", ("hour",), ("count",)),
    ("error_rate_anomalies", ("source", "severity"), ("total_logs", "error_count", "error_rate")),
    ("error_pattern_anomalies", ("pattern", "severity"), ("count", "threshold")),
    ("slow_operations", ("id", "source"), ("response_time",)),
    ("bottlenecks", ("source", "severity"), ("slow_operations", "total_operations", "slow_ratio")),
    ("throughput", ("source",), ("count",)),
    ("security_events", ("event_type",), ("count",)),
    ("ml_anomalies", ("detector", "type", "description"), ("value", "expected", "z_score", "confidence")),
    ("alerts", ("rule", "message"), ("value", "threshold")),
    ("recommendations", ("recommendation",), ("rank",)),
)


def long(section: str, items, numbers, frame: DataFrame) -> DataFrame:
    metric = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in numbers]))
    item = F.concat_ws(" | ", *[F.col(c).cast("string") for c in items]) if items else F.lit("all")
    return frame.select(F.lit(section).alias("section"), item.alias("item"), metric.alias("m")).select(
        "section", "item", "m.metric", "m.value")


def together(parts, frames) -> DataFrame:
    return reduce(DataFrame.unionByName, [long(name, items, numbers, frames[name]) for name, items, numbers in parts])


def detect_patterns(df: DataFrame, terms: int = 20, clusters: int = 10) -> DataFrame:
    """Terms, error signatures, clusters and the two level matrices."""
    return together(PATTERNS, {
        "common_terms": PT.frequent_terms(df, terms), "error_signatures": PT.error_signatures(df),
        "message_clusters": PT.message_clusters(df, clusters), "temporal_patterns": TR.temporal_patterns(df),
        "source_patterns": TR.source_patterns(df)})


def log_trends(df: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Volumes by hour and day, error rates by hour, volume statistics and
    response-time indicators."""
    return together(TRENDS, {
        "hourly_distribution": TR.hourly_distribution(df), "daily_distribution": TR.daily_distribution(df),
        "error_trends": TR.error_trend(df), "volume_statistics": TR.volume_statistics(df),
        "performance_indicators": TR.performance_indicators(df, cfg)})


def report_sections(df: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """The lists of the comprehensive report beside its one-row summary:
    patterns, trends, errors, rule anomalies, slow operations, bottlenecks,
    throughput, security events, merged statistical anomalies, alerts and
    recommendations."""
    own = together(REPORT, {
        "errors_by_level": ER.errors_by_level(df), "errors_by_source": ER.errors_by_source(df),
        "errors_by_hour": ER.error_time_distribution(df), "error_rate_anomalies": AN.high_error_rate_sources(df, cfg),
        "error_pattern_anomalies": AN.frequent_error_patterns(df, cfg), "slow_operations": PF.slow_operations(df, cfg),
        "bottlenecks": PF.bottlenecks(df, cfg), "throughput": TR.throughput_by_source(df),
        "security_events": SC.security_event_counts(df), "ml_anomalies": ML.merged_anomalies(df, cfg=cfg),
        "alerts": RP.alerts(df, cfg), "recommendations": RP.recommendations(df, cfg)})
    return own.unionByName(detect_patterns(df)).unionByName(log_trends(df, cfg))

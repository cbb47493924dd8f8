"""Rule-based anomaly detection (per-source error rate, frequent error patterns).

Both produce rows of the wide anomaly layout so they can be unioned with
the statistical detectors in :mod:`logspark.operators.ml`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..sources.normalize import enrich


def _e(df: DataFrame, *cols) -> DataFrame:
    return enrich(df, cols=cols or ("is_narrow_error", "pattern"))


def source_error_rates(df: DataFrame) -> DataFrame:
    """Per source: total logs, error+fatal count and rate (percent) - one aggregate."""
    return (_e(df, "is_narrow_error").groupBy("source")
            .agg(F.count(F.lit(1)).alias("total_logs"),
                 F.count(F.when(F.col("is_narrow_error"), 1)).alias("error_count"))
            .select("source", "total_logs", "error_count",
                    (F.col("error_count") * 100.0 / F.col("total_logs")).alias("error_rate")))


def high_error_rate_sources(df: DataFrame, cfg: EngineConfig = DEFAULT, facts: DataFrame | None = None) -> DataFrame:
    from .facts import source_error_rates_from
    r = source_error_rates(df) if facts is None else source_error_rates_from(facts)
    return (r.filter((F.col("error_rate") > cfg.high_error_rate_pct) & (F.col("total_logs") > cfg.min_source_logs))
            .select("source", "total_logs", "error_count", "error_rate",
                    F.when(F.col("error_rate") > 50, "high").otherwise("medium").alias("severity")))


def frequent_error_patterns(df: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Error/fatal patterns whose count exceeds mean + k * sample std of all
    pattern counts (needs more than one pattern) and is above 3."""
    # empty patterns are left out by an aggregate: a filter on the pattern would
    # be pushed below and run its chain of rules twice per row
    counts = (_e(df).filter("is_narrow_error").groupBy("pattern")
              .agg(F.count(F.lit(1)).alias("count"), F.max("pattern").alias("_p")).filter(F.col("_p") != "").drop("_p"))
    stats = counts.agg(F.count(F.lit(1)).alias("n_patterns"),
                       (F.avg("count") + F.lit(cfg.threshold_multiplier) * F.stddev_samp("count")).alias("threshold"))
    # ``stats`` is exactly one row: broadcasting it is bounded by construction
    j = counts.crossJoin(F.broadcast(stats)).filter(
        (F.col("n_patterns") > 1) & (F.col("count") > F.col("threshold")) & (F.col("count") > 3))
    return j.select("pattern", "count", "threshold",
                    F.when(F.col("count") > F.col("threshold") * 2, "high").otherwise("medium").alias("severity"))


def rule_anomalies(df: DataFrame, cfg: EngineConfig = DEFAULT, facts: DataFrame | None = None) -> DataFrame:
    """Both rule detectors in the wide anomaly layout."""
    e = _e(df)
    a = high_error_rate_sources(e, cfg, facts).select(
        F.lit("rules").alias("detector"), F.lit("high_error_rate").alias("type"), "source",
        F.lit(None).cast("string").alias("pattern"),
        F.col("error_count").alias("count"), "total_logs",
        F.col("error_rate").alias("value"), F.lit(None).cast("double").alias("threshold"), "severity")
    b = frequent_error_patterns(e, cfg).select(
        F.lit("rules").alias("detector"), F.lit("frequent_error_pattern").alias("type"),
        F.lit(None).cast("string").alias("source"), "pattern", "count",
        F.lit(None).cast("bigint").alias("total_logs"),
        F.col("count").cast("double").alias("value"), "threshold", "severity")
    return a.unionByName(b)

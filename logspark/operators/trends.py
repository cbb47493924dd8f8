"""Volume and trend analysis (counts by key, hour-of-day series, statistics)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..sources.normalize import enrich, normalize_logs
from . import quantiles as Q


def _e(df: DataFrame, cfg: EngineConfig = DEFAULT, cols=("hour",)) -> DataFrame:
    return enrich(df, cfg, cols)


def _count(df: DataFrame, *keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def counts_by_level(df: DataFrame) -> DataFrame:
    return _count(normalize_logs(df), "level")


def counts_by_source(df: DataFrame) -> DataFrame:
    return _count(normalize_logs(df), "source")


throughput_by_source = counts_by_source


def hourly_distribution(df: DataFrame) -> DataFrame:
    """Counts per hour of day (dates fold together, as in the original)."""
    return _count(_e(df).filter(F.col("hour").isNotNull()), "hour")


def daily_distribution(df: DataFrame) -> DataFrame:
    return _count(_e(df, cols=("day",)).filter(F.col("day").isNotNull()), "day")


def error_trend(df: DataFrame) -> DataFrame:
    """Per hour of day: total, error+fatal count and rate (percent), by hour."""
    return (_e(df, cols=("hour", "is_narrow_error")).filter(F.col("hour").isNotNull()).groupBy("hour")
            .agg(F.count(F.lit(1)).alias("total_logs"),
                 F.count(F.when(F.col("is_narrow_error"), 1)).alias("error_count"))
            .select("hour", "total_logs", "error_count",
                    (F.col("error_count") * 100.0 / F.col("total_logs")).alias("error_rate"))
            .orderBy("hour"))


def volume_statistics(df: DataFrame) -> DataFrame:
    """mean, median, sample std (0 for one bucket), min, max of hourly counts."""
    h = hourly_distribution(df)
    return h.agg(
        F.avg("count").alias("mean"),
        F.percentile(F.col("count").cast("double"), F.lit(0.5)).alias("median"),
        F.coalesce(F.stddev_samp("count"), F.lit(0.0)).alias("std_dev"),
        F.min("count").alias("min"),
        F.max("count").alias("max"),
    ).filter(F.col("mean").isNotNull())


def temporal_patterns(df: DataFrame) -> DataFrame:
    """Hour-of-day x level matrix (long form)."""
    return _count(_e(df).filter(F.col("hour").isNotNull()), "hour", "level")


def source_patterns(df: DataFrame) -> DataFrame:
    return _count(normalize_logs(df), "source", "level")


def performance_indicators(df: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Mean, median, p95 (exclusive 20-quantile when n >= 20, else max) and
    count above 1 s of the response times found in messages."""
    rt = _e(df, cfg, ("response_time",)).select(F.col("response_time").alias("v"))
    n = F.col("n")
    slow = F.coalesce(F.sum(F.when(F.col("v") > cfg.slow_request_ms, F.col("c"))), F.lit(0))
    stats = Q.order_statistics(rt, "v", {**Q.median_ranks(n), **Q.exclusive_ranks(n, 19, 20)}, {"slow_requests": slow})
    return stats.select(
        F.col("average").alias("avg_response_time"),
        ((F.col("lower") + F.col("upper")) / 2.0).alias("median_response_time"),
        F.when(n >= 20, Q.exclusive_quantile(n, 19, 20)).otherwise(F.col("max")).alias("p95_response_time"),
        "slow_requests",
    )

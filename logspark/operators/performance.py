"""Response-time performance analysis (distribution, slow operations, bottlenecks)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import text as X
from ..sources.normalize import normalize_logs
from . import quantiles as Q


def response_times(df: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """One row per log with a non-zero timing in its message."""
    n = normalize_logs(df)
    return (n.select("id", "log_ts", "source", "message",
                     X.response_time("message", cfg.unit_mode).alias("response_time"))
            .filter(F.col("response_time").isNotNull()))


def response_time_distribution(df: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """average, min, max and nearest-rank p50/p95/p99 (element int(q*n))."""
    n = F.col("n")
    timed = normalize_logs(df).select(X.response_time("message", cfg.unit_mode).alias("response_time"))
    return Q.order_statistics(timed, "response_time", {
        "p50": F.floor(n / 2), "p95": Q.nearest_rank(n, 0.95), "p99": Q.nearest_rank(n, 0.99),
    }).select("average", "min", "max", "p50", "p95", "p99")


def _slow(df: DataFrame, cfg: EngineConfig) -> DataFrame:
    return response_times(df, cfg).filter(F.col("response_time") > cfg.performance_threshold_ms)


def slow_operations(df: DataFrame, cfg: EngineConfig = DEFAULT, top: int = 10) -> DataFrame:
    """The ``top`` slowest operations (id breaks ties); message cut to 100 chars."""
    return (_slow(df, cfg).select("id", "log_ts", "source", "response_time",
                                  X.truncate("message").alias("message"))
            .orderBy(F.col("response_time").desc(), F.col("id")).limit(top))


def bottlenecks(df: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Sources where more than 10 % of all their logs are slow operations.

    One grouped aggregate computes both the slow count and the total per
    source, so no join is needed.
    """
    n = normalize_logs(df)
    rt = X.response_time("message", cfg.unit_mode)
    per = (n.groupBy("source")
           .agg(F.count(F.when(rt > cfg.performance_threshold_ms, 1)).alias("slow_operations"),
                F.count(F.lit(1)).alias("total_operations")))
    return (per.filter(F.col("slow_operations") > 0)
            .select("source", "slow_operations", "total_operations",
                    (F.col("slow_operations") / F.col("total_operations")).alias("slow_ratio"))
            .filter(F.col("slow_ratio") > 0.1)
            .select("*", F.when(F.col("slow_ratio") > 0.3, "high").otherwise("medium").alias("severity")))


def performance_summary(df: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """One row: timed operations, mean, score max(0, 100 - mean/100) (0 without
    timings), slow operations (untruncated count) and total operations."""
    n = normalize_logs(df)
    rt = X.response_time("message", cfg.unit_mode)
    return n.agg(
        F.count(rt).alias("timed_operations"),
        F.avg(rt).alias("average_response_time"),
        F.count(F.when(rt > cfg.performance_threshold_ms, 1)).alias("slow_operations"),
        F.count(F.lit(1)).alias("total_operations"),
    ).select("*", F.coalesce(F.greatest(F.lit(0.0), 100.0 - F.col("average_response_time") / 100.0),
                             F.lit(0.0)).alias("performance_score"))

"""Log facts: counts and sums per (source, level, hour of day).

Every report section (error frequency, severity, volume statistics, source
diversity, time range, most active source, peak hour, response-time summary,
slow operations, security counts, per-source error rates) is a sum or count
that decomposes over these groups.  The facts frame is at most
#sources x #levels x 25 rows whatever the input size, and partial
aggregation builds it with one shuffle of that many rows per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import levels as L
from ..functions import text as X
from ..sources.normalize import normalize_logs
from .security import SECURITY_RULES

FACT_KEYS = ("source", "level", "hour")


def _hit(etype: str):
    low = F.lower(F.col("message"))
    cond = None
    for p in SECURITY_RULES[etype]:
        cond = low.contains(p) if cond is None else (cond | low.contains(p))
    return cond


ALL_MEASURES = ("timing", "security", "span")


def log_facts(df: DataFrame, cfg: EngineConfig = DEFAULT, measures=ALL_MEASURES) -> DataFrame:
    """Facts with the row count ``c`` plus the requested measure groups:
    ``timing`` (rt_n, rt_sum, slow), ``security`` (sec_<type>), ``span`` (t0, t1)."""
    n = normalize_logs(df)
    aggs = [F.count(F.lit(1)).alias("c")]
    if "timing" in measures:
        rt = X.response_time("message", cfg.unit_mode)
        aggs += [F.count(rt).alias("rt_n"), F.sum(rt).alias("rt_sum"),
                 F.count(F.when(rt > cfg.performance_threshold_ms, 1)).alias("slow")]
    if "security" in measures:
        aggs += [F.count(F.when(_hit(t), 1)).alias(f"sec_{t}") for t in SECURITY_RULES]
    if "span" in measures:
        aggs += [F.min("log_ts").alias("t0"), F.max("log_ts").alias("t1")]
    return n.groupBy("source", "level", F.hour("log_ts").cast("bigint").alias("hour")).agg(*aggs)


def checkpointed_facts(df: DataFrame, cfg: EngineConfig = DEFAULT, measures=ALL_MEASURES) -> DataFrame:
    """The log facts, checkpointed: a few hundred rows at most, written once to
    the shared checkpoint folder so that every section derived from them
    reads that instead of rescanning the input (and lineage is cut there).
    Each consumer prunes different columns, so without this Spark could not
    reuse one exchange and would scan the input once per section."""
    from ..config import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    return log_facts(df, cfg, measures).checkpoint(eager=True)


def error_frequency_from(f: DataFrame) -> DataFrame:
    broad = L.is_broad_error(F.col("level"))
    w = L.severity_weight("level")
    return f.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("total_logs"),
                 F.coalesce(F.sum(F.when(broad, F.col("c"))), F.lit(0)).alias("total_errors"),
                 F.sum(F.col("c") * w).alias("_w")).select(
        "total_logs", "total_errors",
        F.when(F.col("total_logs") > 0, F.col("total_errors") * 100.0 / F.col("total_logs"))
         .otherwise(F.lit(0.0)).alias("error_rate"),
        F.when(F.col("total_logs") > 0, F.col("_w") / F.col("total_logs")).otherwise(F.lit(0.0)).alias("severity_score"))


def errors_by_source_from(f: DataFrame) -> DataFrame:
    return (f.filter(L.is_broad_error(F.col("level"))).groupBy("source")
            .agg(F.sum("c").alias("count")))


def source_error_rates_from(f: DataFrame) -> DataFrame:
    narrow = L.is_narrow_error(F.col("level"))
    return (f.groupBy("source").agg(F.sum("c").alias("total_logs"),
                                    F.sum(F.when(narrow, F.col("c")).otherwise(0)).alias("error_count"))
            .select("source", "total_logs", "error_count",
                    (F.col("error_count") * 100.0 / F.col("total_logs")).alias("error_rate")))


def hourly_from(f: DataFrame) -> DataFrame:
    return f.filter(F.col("hour").isNotNull()).groupBy("hour").agg(F.sum("c").alias("c"))


def performance_from(f: DataFrame) -> DataFrame:
    return f.agg(F.coalesce(F.sum("rt_n"), F.lit(0)).alias("timed_operations"),
                 (F.sum("rt_sum") / F.sum("rt_n")).alias("average_response_time"),
                 F.coalesce(F.sum("slow"), F.lit(0)).alias("slow_operations"),
                 F.coalesce(F.sum("c"), F.lit(0)).alias("total_operations")).select(
        "*", F.coalesce(F.greatest(F.lit(0.0), 100.0 - F.col("average_response_time") / 100.0),
                        F.lit(0.0)).alias("performance_score"))


def security_from(f: DataFrame) -> DataFrame:
    s = f.agg(*[F.coalesce(F.sum(f"sec_{t}"), F.lit(0)).alias(t) for t in SECURITY_RULES])
    threats = F.col("suspicious") + F.col("injection")
    total = F.col("failed_login") + F.col("access_violation") + threats
    return s.select(F.col("failed_login").alias("failed_logins"),
                    F.col("access_violation").alias("access_violations"),
                    threats.alias("threats_detected"), total.alias("total_security_events"),
                    F.greatest(F.lit(0), 100 - 5 * total).cast("bigint").alias("security_score"))

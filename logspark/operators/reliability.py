"""Reliability score and executive summary (one-row frames).

Both are derived from the log facts (see :mod:`logspark.operators.facts`):
one scan of the input, and every cross join combines one-row aggregates of
that small frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import levels as L
from . import facts as FT


def _facts(df: DataFrame, facts: DataFrame | None, measures=()) -> DataFrame:
    return facts if facts is not None else FT.checkpointed_facts(df, measures=measures)


def reliability_score(df: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """error-rate factor max(0, 40 - 2*rate) + severity factor max(0, 20 - severity)
    + volume consistency (20, or max(0, 20 - 10*cv) when hourly std > 0)
    + source diversity min(20, 2 * sources); letter grade A..F."""
    f = _facts(df, facts)
    ef = FT.error_frequency_from(f)
    vs = FT.hourly_from(f).agg(F.avg("c").alias("volume_mean"),
                               F.coalesce(F.stddev_samp("c"), F.lit(0.0)).alias("volume_std"))
    src = f.agg(F.countDistinct("source").alias("source_count"))
    j = ef.crossJoin(vs).crossJoin(src).filter(F.col("total_logs") > 0)
    out = j.select(
        "error_rate", "severity_score", "volume_std", "source_count",
        F.greatest(F.lit(0.0), 40.0 - F.col("error_rate") * 2).alias("error_rate_factor"),
        F.greatest(F.lit(0.0), 20.0 - F.col("severity_score")).alias("severity_factor"),
        F.when(F.col("volume_std") > 0,
               F.greatest(F.lit(0.0), 20.0 - F.col("volume_std") / F.col("volume_mean") * 10))
         .otherwise(F.lit(20.0)).alias("volume_factor"),
        F.least(F.lit(20.0), F.col("source_count") * 2.0).alias("source_factor"),
    )
    score = F.col("error_rate_factor") + F.col("severity_factor") + F.col("volume_factor") + F.col("source_factor")
    return out.select("*", score.alias("score")).select("*", L.reliability_grade(F.col("score")).alias("grade"))


def report_summary(df: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Totals, ISO time range, health status, rounded error rate, most active
    source and peak hour (ties broken by name / hour ascending)."""
    f = _facts(df, facts, ("span",))
    ef = FT.error_frequency_from(f)
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    tr = f.agg(F.min("t0").alias("t0"), F.max("t1").alias("t1")).select(
        F.coalesce(F.concat(F.date_format("t0", iso), F.lit(" to "), F.date_format("t1", iso)),
                   F.lit("Unknown")).alias("time_range"))
    top_src = (f.groupBy("source").agg(F.sum("c").alias("c"))
               .agg(F.min_by("source", F.struct(-F.col("c"), F.col("source"))).alias("most_active_source")))
    peak = (FT.hourly_from(f)
            .agg(F.min_by("hour", F.struct(-F.col("c"), F.col("hour"))).alias("peak_activity_hour")))
    j = ef.crossJoin(tr).crossJoin(top_src).crossJoin(peak).filter(F.col("total_logs") > 0)
    return j.select(
        F.col("total_logs").alias("total_logs_analyzed"), "time_range",
        L.health_status(F.col("error_rate")).alias("health_status"),
        F.col("total_errors").alias("error_count"),
        F.round("error_rate", 2).alias("error_rate"),
        F.coalesce(F.col("most_active_source"), F.lit("unknown")).alias("most_active_source"),
        "peak_activity_hour")

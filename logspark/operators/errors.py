"""Error frequency analysis (counts, rates, severity, error patterns).

All aggregates group on low-cardinality keys (level, source, hour) or none,
so Spark's partial aggregation reduces every map task to a handful of rows
before the shuffle; a hot source costs nothing extra.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.normalize import enrich
from ..sources.scans import newest_ts, ts_lit


def _e(df: DataFrame, *cols) -> DataFrame:
    return enrich(df, cols=cols or ("is_broad_error",))


def error_logs(df: DataFrame) -> DataFrame:
    """Rows whose level is error, fatal or warn."""
    return _e(df).filter("is_broad_error").select("id", "log_ts", "level", "message", "source")


def error_frequency(df: DataFrame) -> DataFrame:
    """One row: total logs, broad errors, error rate (percent), mean severity."""
    e = _e(df, "is_broad_error", "severity_weight")
    return e.agg(
        F.count(F.lit(1)).alias("total_logs"),
        F.count(F.when(F.col("is_broad_error"), 1)).alias("total_errors"),
        F.coalesce(F.avg(F.when(F.col("is_broad_error"), 100.0).otherwise(0.0)), F.lit(0.0)).alias("error_rate"),
        F.coalesce(F.avg("severity_weight"), F.lit(0.0)).alias("severity_score"),
    )


def severity_score(df: DataFrame) -> DataFrame:
    return error_frequency(df).select("severity_score")


def errors_by_level(df: DataFrame) -> DataFrame:
    return _e(df).filter("is_broad_error").groupBy("level").agg(F.count(F.lit(1)).alias("count"))


def errors_by_source(df: DataFrame) -> DataFrame:
    return _e(df).filter("is_broad_error").groupBy("source").agg(F.count(F.lit(1)).alias("count"))


def error_time_distribution(df: DataFrame) -> DataFrame:
    return (_e(df, "is_broad_error", "hour").filter(F.col("is_broad_error") & F.col("hour").isNotNull())
            .groupBy("hour").agg(F.count(F.lit(1)).alias("count")))


def error_pattern_rows(df: DataFrame) -> DataFrame:
    """One row per broad error whose generalised pattern is non-empty."""
    return (_e(df, "is_broad_error", "pattern").filter(F.col("is_broad_error") & (F.col("pattern") != ""))
            .select("id", "pattern", "message", "level", "source", "log_ts"))


def error_pattern_counts(df: DataFrame) -> DataFrame:
    return (error_pattern_rows(df).groupBy("pattern")
            .agg(F.count(F.lit(1)).alias("count")))


def _since(df: DataFrame, hours: int, as_of):
    as_of = newest_ts(df) if as_of is None else as_of
    return df.filter(F.col("log_ts") >= ts_lit(as_of - _dt.timedelta(hours=hours)))


def error_summary(df: DataFrame, hours: int = 24, as_of=None) -> DataFrame:
    """Last ``hours`` before ``as_of`` in one scan: totals, per-level error
    counts, narrow error total (error + fatal) and its rate."""
    w = _since(df, hours, as_of)
    lv = F.col("level")
    return w.agg(
        F.count(F.lit(1)).alias("total_logs"),
        F.count(F.when(lv == "error", 1)).alias("error_count"),
        F.count(F.when(lv == "fatal", 1)).alias("fatal_count"),
        F.count(F.when(lv == "warn", 1)).alias("warn_count"),
    ).select("*", (F.col("error_count") + F.col("fatal_count")).alias("total_errors")).select(
        "*", F.when(F.col("total_logs") > 0, F.col("total_errors") * 100.0 / F.col("total_logs"))
              .otherwise(F.lit(0.0)).alias("error_rate"))


def error_summary_by_source(df: DataFrame, hours: int = 24, as_of=None, top: int = 10) -> DataFrame:
    """Top ``top`` sources by error+fatal count in the window (name breaks ties)."""
    w = _since(df, hours, as_of)
    return (w.filter(F.col("level").isin("error", "fatal")).groupBy("source")
            .agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), F.col("source")).limit(top))


def min_level_filter(df: DataFrame, min_level: str = "WARN") -> DataFrame:
    """Rows at or above ``min_level`` in DEBUG < INFO < WARN < ERROR < FATAL
    (levels compared case-insensitively; unknown names rank as INFO)."""
    from ..functions import levels as L
    threshold = L.LEVEL_ORDINALS.get(min_level.upper(), 1)
    return df.filter(L.level_ordinal(F.upper(F.col("level"))) >= threshold)


def level_parse(df: DataFrame, col: str = "level") -> DataFrame:
    """How the service loggers read each level spelling: ordinal and
    canonical name, with the number of rows carrying it."""
    from ..functions import levels as L
    o = L.level_ordinal(F.col(col))
    return (df.filter(F.col(col).isNotNull())
            .groupBy(F.col(col).alias("level_text"), o.alias("ordinal"), L.level_name(o).alias("level_name"))
            .agg(F.count(F.lit(1)).alias("count")))

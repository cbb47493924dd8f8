"""Registry of named queries: a Spark builder and, where SQL can say it, an
independent DuckDB oracle over the same stored tables.

Every builder takes ``(spark, sf_dir)`` and reads the stored tables (or
frames Spark derives from them), so its work grows with the data.  Double
columns are rounded to 6 places on both sides (engines differ in the last
bits of aggregates such as stddev).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, EngineConfig
from ..sources import scans
from ..sources.normalize import enrich
from ..sources.tables import load_logs, load_raw_events
from . import sqlbits as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def finalize(df: DataFrame) -> DataFrame:
    """Round doubles to 6 places (the oracle does the same)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f"`{f.name}`"), 6).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # the engine works in UTC: parsed offsets, day windows and ISO
            # renderings must not depend on the caller's session zone
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return finalize(fn(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run
    return deco


def R(expr: str) -> str:
    return f"ROUND({expr}, 6)"


def _logs(spark, d):
    return load_logs(spark, d)


def _elogs(spark, d, cfg: EngineConfig = DEFAULT):
    return enrich(load_logs(spark, d), cfg)


LOG_COLS = "id, log_ts, level, message, source"
MAX_TS = "(SELECT max(log_ts) FROM logs)"

# ---------------------------------------------------------------- scans -----
from ..operators import errors as E  # noqa: E402
from ..operators import trends as TR  # noqa: E402


@register("recent_logs", S.with_views(
    f"SELECT {LOG_COLS} FROM logs ORDER BY log_ts DESC, id DESC LIMIT 1000"))
def _recent_logs(spark, d):
    return scans.recent_logs(_logs(spark, d), 1000).select("id", "log_ts", "level", "message", "source")


RANGE_START, RANGE_END = "2024-01-10 00:00:00", "2024-01-12 00:00:00"


@register("logs_by_time_range", S.with_views(
    f"SELECT {LOG_COLS} FROM logs WHERE log_ts BETWEEN TIMESTAMP '{RANGE_START}' AND TIMESTAMP '{RANGE_END}'"))
def _logs_by_time_range(spark, d):
    return scans.logs_by_time_range(_logs(spark, d), RANGE_START, RANGE_END).select(
        "id", "log_ts", "level", "message", "source")


@register("logs_by_level", S.with_views(
    f"SELECT {LOG_COLS} FROM logs WHERE level = 'error' ORDER BY log_ts DESC, id DESC LIMIT 1000"))
def _logs_by_level(spark, d):
    return scans.logs_by_level(_logs(spark, d), "error", 1000).select("id", "log_ts", "level", "message", "source")


@register("logs_by_source", S.with_views(
    f"SELECT {LOG_COLS} FROM logs WHERE source = 'auth_service' ORDER BY log_ts DESC, id DESC LIMIT 1000"))
def _logs_by_source(spark, d):
    return scans.logs_by_source(_logs(spark, d), "auth_service", 1000).select(
        "id", "log_ts", "level", "message", "source")


@register("historical_baseline", S.with_views(
    f"SELECT {LOG_COLS} FROM logs WHERE log_ts BETWEEN {MAX_TS} - INTERVAL 8 DAY AND {MAX_TS} - INTERVAL 1 DAY"))
def _historical_baseline(spark, d):
    return scans.historical_baseline(_logs(spark, d), 7).select("id", "log_ts", "level", "message", "source")


@register("logs_last_hours", S.with_views(
    f"SELECT {LOG_COLS} FROM logs WHERE log_ts BETWEEN {MAX_TS} - INTERVAL 24 HOUR AND {MAX_TS}"))
def _logs_last_hours(spark, d):
    return scans.last_interval(_logs(spark, d), hours=24).select("id", "log_ts", "level", "message", "source")


@register("table_stats", S.with_views(
    "SELECT count(*) AS total_logs, min(log_ts) AS oldest_ts, max(log_ts) AS newest_ts FROM logs"))
def _table_stats(spark, d):
    return scans.table_stats(_logs(spark, d))


# --------------------------------------------------------------- errors -----
@register("error_logs", S.with_views(f"SELECT {LOG_COLS} FROM logs WHERE {S.BROAD}"))
def _error_logs(spark, d):
    return E.error_logs(_logs(spark, d)).select("id", "log_ts", "level", "message", "source")


@register("error_frequency", S.with_views(
    f"""SELECT count(*) AS total_logs, count(*) FILTER (WHERE {S.BROAD}) AS total_errors,
 {R(f"COALESCE(avg(CASE WHEN {S.BROAD} THEN 100.0 ELSE 0.0 END), 0.0)")} AS error_rate,
 {R(f"COALESCE(avg({S.severity_weight()}), 0.0)")} AS severity_score FROM logs"""))
def _error_frequency(spark, d):
    return E.error_frequency(_logs(spark, d))


@register("severity_score", S.with_views(
    f"SELECT {R(f'COALESCE(avg({S.severity_weight()}), 0.0)')} AS severity_score FROM logs"))
def _severity_score(spark, d):
    return E.severity_score(_logs(spark, d))


@register("errors_by_level", S.with_views(
    f"SELECT level, count(*) AS count FROM logs WHERE {S.BROAD} GROUP BY level"))
def _errors_by_level(spark, d):
    return E.errors_by_level(_logs(spark, d))


@register("errors_by_source", S.with_views(
    f"SELECT source, count(*) AS count FROM logs WHERE {S.BROAD} GROUP BY source"))
def _errors_by_source(spark, d):
    return E.errors_by_source(_logs(spark, d))


@register("error_time_distribution", S.with_views(
    f"SELECT CAST(hour(log_ts) AS BIGINT) AS hour, count(*) AS count FROM logs WHERE {S.BROAD} GROUP BY 1"))
def _error_time_distribution(spark, d):
    return E.error_time_distribution(_logs(spark, d))


@register("error_pattern_rows", S.with_views(
    "SELECT id, pattern, message, level, source, log_ts FROM elogs WHERE is_broad_error AND pattern <> ''",
    enriched=True))
def _error_pattern_rows(spark, d):
    return E.error_pattern_rows(_logs(spark, d))


@register("error_pattern_counts", S.with_views(
    "SELECT pattern, count(*) AS count FROM elogs WHERE is_broad_error AND pattern <> '' GROUP BY pattern",
    enriched=True))
def _error_pattern_counts(spark, d):
    return E.error_pattern_counts(_logs(spark, d))


_WIN24 = f"log_ts >= {MAX_TS} - INTERVAL 24 HOUR"


@register("error_summary", S.with_views(
    f"""SELECT total_logs, error_count, fatal_count, warn_count, error_count + fatal_count AS total_errors,
 {R("CASE WHEN total_logs > 0 THEN (error_count + fatal_count) * 100.0 / total_logs ELSE 0.0 END")} AS error_rate
FROM (SELECT count(*) AS total_logs, count(*) FILTER (WHERE level = 'error') AS error_count,
 count(*) FILTER (WHERE level = 'fatal') AS fatal_count, count(*) FILTER (WHERE level = 'warn') AS warn_count
 FROM logs WHERE {_WIN24})"""))
def _error_summary(spark, d):
    return E.error_summary(_logs(spark, d), 24)


@register("error_summary_by_source", S.with_views(
    f"""SELECT source, count(*) AS count FROM logs WHERE {_WIN24} AND level IN ('error', 'fatal')
GROUP BY source ORDER BY count DESC, source LIMIT 10"""))
def _error_summary_by_source(spark, d):
    return E.error_summary_by_source(_logs(spark, d), 24)


# --------------------------------------------------------------- trends -----
@register("counts_by_level", S.with_views("SELECT level, count(*) AS count FROM logs GROUP BY level"))
def _counts_by_level(spark, d):
    return TR.counts_by_level(_logs(spark, d))


@register("counts_by_source", S.with_views("SELECT source, count(*) AS count FROM logs GROUP BY source"))
def _counts_by_source(spark, d):
    return TR.counts_by_source(_logs(spark, d))


@register("throughput_by_source", S.with_views("SELECT source, count(*) AS count FROM logs GROUP BY source"))
def _throughput_by_source(spark, d):
    return TR.throughput_by_source(_logs(spark, d))


@register("hourly_distribution", S.with_views(
    "SELECT CAST(hour(log_ts) AS BIGINT) AS hour, count(*) AS count FROM logs GROUP BY 1"))
def _hourly_distribution(spark, d):
    return TR.hourly_distribution(_logs(spark, d))


@register("daily_distribution", S.with_views(
    "SELECT strftime(log_ts, '%Y-%m-%d') AS day, count(*) AS count FROM logs GROUP BY 1"))
def _daily_distribution(spark, d):
    return TR.daily_distribution(_logs(spark, d))


@register("error_trend", S.with_views(
    f"""SELECT hour, total_logs, error_count, {R("error_count * 100.0 / total_logs")} AS error_rate FROM (
 SELECT CAST(hour(log_ts) AS BIGINT) AS hour, count(*) AS total_logs,
  count(*) FILTER (WHERE {S.NARROW}) AS error_count FROM logs GROUP BY 1) ORDER BY hour"""))
def _error_trend(spark, d):
    return TR.error_trend(_logs(spark, d))


@register("volume_statistics", S.with_views(
    f"""SELECT {R("avg(c)")} AS mean, {R("quantile_cont(CAST(c AS DOUBLE), 0.5)")} AS median,
 {R("COALESCE(stddev_samp(c), 0.0)")} AS std_dev, min(c) AS min, max(c) AS max
FROM (SELECT hour(log_ts) AS h, count(*) AS c FROM logs GROUP BY 1)"""))
def _volume_statistics(spark, d):
    return TR.volume_statistics(_logs(spark, d))


@register("temporal_patterns", S.with_views(
    "SELECT CAST(hour(log_ts) AS BIGINT) AS hour, level, count(*) AS count FROM logs GROUP BY 1, 2"))
def _temporal_patterns(spark, d):
    return TR.temporal_patterns(_logs(spark, d))


@register("source_patterns", S.with_views(
    "SELECT source, level, count(*) AS count FROM logs GROUP BY 1, 2"))
def _source_patterns(spark, d):
    return TR.source_patterns(_logs(spark, d))


def _rt_cte(unit_mode="intended"):
    return f"rt AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k, count(*) OVER () AS n FROM (SELECT {S.response_time('message', unit_mode)} AS v FROM logs) WHERE v IS NOT NULL)"


@register("performance_indicators", S.with_views(
    f"""SELECT {R("avg(v)")} AS avg_response_time, {R("quantile_cont(v, 0.5)")} AS median_response_time,
 {R("CASE WHEN max(n) >= 20 THEN (max(v) FILTER (WHERE k = j - 1) * (20 - max(delta)) + max(v) FILTER (WHERE k = j) * max(delta)) / 20.0 ELSE max(v) END")} AS p95_response_time,
 count(*) FILTER (WHERE v > 1000) AS slow_requests
FROM (SELECT *, 19 * (n + 1) - j * 20 AS delta FROM (
  SELECT *, LEAST(GREATEST(19 * (n + 1) // 20, 1), n - 1) AS j FROM rt))
HAVING count(*) > 0""", extra=_rt_cte()))
def _performance_indicators(spark, d):
    return TR.performance_indicators(_logs(spark, d))


_ORD = ("CASE upper(level) WHEN 'DEBUG' THEN 0 WHEN 'INFO' THEN 1 WHEN 'WARN' THEN 2 WHEN 'WARNING' THEN 2 "
        "WHEN 'ERROR' THEN 3 WHEN 'FATAL' THEN 4 ELSE 1 END")


@register("min_level_filter", S.with_views(f"SELECT {LOG_COLS} FROM logs WHERE {_ORD} >= 2"))
def _min_level_filter(spark, d):
    return E.min_level_filter(_logs(spark, d), "WARN").select("id", "log_ts", "level", "message", "source")


@register("level_parse", S.with_views(
    """SELECT level_text, ordinal, CASE ordinal WHEN 0 THEN 'DEBUG' WHEN 1 THEN 'INFO' WHEN 2 THEN 'WARN'
   WHEN 3 THEN 'ERROR' WHEN 4 THEN 'FATAL' ELSE 'UNKNOWN' END AS level_name, count(*) AS count
FROM (SELECT level_text, CASE level_text WHEN 'DEBUG' THEN 0 WHEN 'INFO' THEN 1 WHEN 'WARN' THEN 2
   WHEN 'WARNING' THEN 2 WHEN 'ERROR' THEN 3 WHEN 'FATAL' THEN 4 ELSE 1 END AS ordinal
 FROM (SELECT json_extract_string(payload, '$.level') AS level_text FROM raw_events WHERE json_valid(payload))
 WHERE level_text IS NOT NULL) GROUP BY 1, 2""", logs=False, raw=True))
def _level_parse(spark, d):
    raw = load_raw_events(spark, d)
    return E.level_parse(raw.select(F.get_json_object("payload", "$.level").alias("level")))

"""The fixed reads of the original service, as filtered/sorted scans.

Filters on ``log_ts``, ``level`` and ``source`` are plain column predicates so
Catalyst pushes them into the Parquet scan (and prunes date partitions of a
table written with :func:`logspark.sinks.writers.write_logs`).  Anything that
needs a reference time takes ``as_of``; by default the newest timestamp in
the data, fetched as one scalar, never the wall clock.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ts_lit(value):
    """A TIMESTAMP_NTZ literal for a Python datetime (no session/local zone shift)."""
    if isinstance(value, str):
        return F.lit(value).cast("timestamp_ntz")
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def newest_ts(df: DataFrame, col: str = "log_ts"):
    """max(timestamp) as a Python value (one scalar; column-pruned scan)."""
    return df.agg(F.max(col)).first()[0]


def _as_of(df: DataFrame, as_of):
    return newest_ts(df) if as_of is None else as_of


def _newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("log_ts").desc(), F.col("id").desc())


def recent_logs(df: DataFrame, limit: int = 1000) -> DataFrame:
    """Newest ``limit`` rows (TakeOrderedAndProject: per-partition top-N, no full sort)."""
    return _newest_first(df).limit(limit)


def logs_by_time_range(df: DataFrame, start, end) -> DataFrame:
    """Rows with start <= log_ts <= end, newest first."""
    return _newest_first(df.filter(F.col("log_ts").between(ts_lit(start), ts_lit(end))))


def logs_by_level(df: DataFrame, level: str, limit: int | None = 1000) -> DataFrame:
    out = _newest_first(df.filter(F.col("level") == level))
    return out.limit(limit) if limit else out


def logs_by_source(df: DataFrame, source: str, limit: int | None = 1000) -> DataFrame:
    out = _newest_first(df.filter(F.col("source") == source))
    return out.limit(limit) if limit else out


def historical_baseline(df: DataFrame, days: int = 7, as_of=None) -> DataFrame:
    """Rows in [as_of - 1 day - days, as_of - 1 day]: history without the last 24 h."""
    end = _as_of(df, as_of) - _dt.timedelta(days=1)
    start = end - _dt.timedelta(days=days)
    return logs_by_time_range(df, start, end)


def last_interval(df: DataFrame, hours: int | None = None, days: int | None = None,
                  recent: int = 1000, as_of=None) -> DataFrame:
    """CLI relative range: hours wins over days, days over the newest ``recent`` rows."""
    if hours or days:
        end = _as_of(df, as_of)
        delta = _dt.timedelta(hours=hours) if hours else _dt.timedelta(days=days)
        return logs_by_time_range(df, end - delta, end)
    return recent_logs(df, recent)


def table_stats(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_logs"),
                  F.min("log_ts").alias("oldest_ts"),
                  F.max("log_ts").alias("newest_ts"))

"""HTTP access-log analytics (what the ingest service's middleware logs).

Input: an access frame ``(id, log_ts, http_method, http_path,
http_status_code, duration_ms, http_remote_addr, http_user_agent, ...)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import levels as L
from .buckets import ROWS_PER_BUCKET, bucketed

# fixed values: paths the middleware does not inspect
HEALTH_PATHS = ("/health", "/healthz")
# characters a URL path may carry unescaped (RFC 3986 pchar plus '/')
PATH_SAFE = r"^[A-Za-z0-9\-._~!$&'()*+,;=:@/]*$"


def access_severity(acc: DataFrame) -> DataFrame:
    """Requests per outcome class: >= 500 error, >= 400 warn, else info.

    When the frame carries the logged size columns (``content_length``,
    ``response_size``) their totals and means are added per class."""
    aggs = [F.count(F.lit(1)).alias("requests"), F.avg("duration_ms").alias("avg_duration_ms")]
    for c in ("content_length", "response_size"):
        if c in acc.columns:
            aggs += [F.sum(c).alias(f"total_{c}"), F.avg(c).alias(f"avg_{c}")]
    return acc.groupBy(L.status_severity(F.col("http_status_code")).alias("severity")).agg(*aggs)


def access_slow(acc: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Requests that took strictly longer than the slow limit (5 s)."""
    return (acc.filter(F.col("duration_ms") > cfg.access_slow_ms)
            .select("id", "log_ts", "http_method", "http_path", "duration_ms"))


def access_non_health(acc: DataFrame) -> DataFrame:
    return acc.filter(~F.col("http_path").isin(*HEALTH_PATHS))


def access_suspicious(acc: DataFrame) -> DataFrame:
    """Non-health requests with an empty user agent, or a path that changes
    when escaped (characters outside the unreserved set, e.g. '%' or ' ')."""
    a = access_non_health(acc)
    empty_ua = F.coalesce(F.col("http_user_agent"), F.lit("")) == ""
    encoded = ~F.col("http_path").rlike(PATH_SAFE)
    return (a.filter(empty_ua | encoded)
            .select("id", "log_ts", "http_path", "http_remote_addr",
                    empty_ua.alias("empty_user_agent"), encoded.alias("url_encoding")))


def rate_limit_decisions(acc: DataFrame, window: str | None = None, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Per client and fixed window: requests ok (served unflagged), flagged as high rate
    (the 51st to 100th) and rejected (beyond the 100th).

    The n-th request of a window is classified by n alone, so the class
    counts follow from the window's request count - a plain aggregate with
    map-side partial counts, safe for a client holding most of the traffic.
    """
    window = window or cfg.rate_window
    c = (acc.groupBy("http_remote_addr", F.window("log_ts", window).start.alias("window_start"))
         .agg(F.count(F.lit(1)).alias("requests")))
    n = F.col("requests")
    return c.select(
        "http_remote_addr", "window_start", "requests",
        F.least(n, F.lit(cfg.rate_notice)).alias("ok"),
        F.least(F.greatest(n - cfg.rate_notice, F.lit(0)), F.lit(cfg.rate_limit - cfg.rate_notice)).alias("high_rate"),
        F.greatest(n - cfg.rate_limit, F.lit(0)).alias("rejected"))


def request_ids(acc: DataFrame, given_col: str | None = None) -> DataFrame:
    """Keep a given request id, else derive a stable UUID-shaped id from the
    row id (sha-256), so reruns and retries produce the same ids."""
    h = F.sha2(F.concat(F.lit("request:"), F.col("id").cast("string")), 256)
    derived = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                          F.substring(h, 17, 4), F.substring(h, 21, 12))
    rid = derived if given_col is None else F.coalesce(F.nullif(F.col(given_col), F.lit("")), derived)
    return acc.select("id", rid.alias("request_id"))


def span_metrics(entries: DataFrame) -> DataFrame:
    """Per operation (method + path) and outcome: count, mean and max duration,
    from parsed service-log entries whose ``fields`` hold the request data."""
    f = F.col("fields")
    status = F.element_at(f, "http_status_code").try_cast("int")
    dur = F.element_at(f, "duration_ms").try_cast("double")
    op = F.concat_ws(" ", F.element_at(f, "http_method"), F.element_at(f, "http_path"))
    return (entries.filter(dur.isNotNull())
            .groupBy(op.alias("operation"), F.when(status >= 400, "error").otherwise("success").alias("status"))
            .agg(F.count(F.lit(1)).alias("count"), F.avg(dur).alias("avg_duration_ms"),
                 F.max(dur).alias("max_duration_ms")))


def slow_entries(entries: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Service-log entries whose recorded duration exceeds the slow-operation
    limit of the database layer (100 ms)."""
    dur = F.element_at(F.col("fields"), "duration_ms").try_cast("double")
    return (entries.filter(dur > cfg.db_slow_ms)
            .select("id", "request_id", dur.alias("duration_ms"), "message"))


def business_event_counts(accepted: DataFrame) -> DataFrame:
    """The ingest handler emits one ``log_ingested`` business event per stored
    log; count them by level and source."""
    return (accepted.groupBy(F.lit("log_ingested").alias("business_event"), "level", "source")
            .agg(F.count(F.lit(1)).alias("count")))


def rank_within(df: DataFrame, keys, order, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """1-based position of each row inside its ``keys`` group in ``order``,
    whose first column is the time and whose others are whole numbers that
    break ties (the last one should be a unique id).

    ``row_number()`` over ``partitionBy(keys)`` would sort a hot group in one
    task.  Here rows are ranked inside pieces of their group (see
    :mod:`.buckets`) and offset by the rows of the group's earlier buckets - a running sum over
    one row per (group, bucket).
    """
    order = list(order)
    r = bucketed(df, keys, order, rows_per_bucket)
    local = r.withColumn("_local", F.row_number().over(Window.partitionBy("_key", "_bucket").orderBy(*order)))
    before = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (r.groupBy("_key", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
               .drop("_n"))
    return (local.join(offsets, ["_key", "_bucket"])
            .withColumn("rank", (F.col("_local") + F.col("_offset")).cast("bigint"))
            .drop("_key", "_bucket", "_local", "_offset"))


def rate_limit_requests(acc: DataFrame, window: str | None = None, cfg: EngineConfig = DEFAULT,
                        rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Per request: its position in the client's fixed window and the
    decision (ok, high_rate from the 51st, rejected from the 101st)."""
    window = window or cfg.rate_window
    w = acc.select("id", "log_ts", "http_remote_addr", F.window("log_ts", window).start.alias("window_start"))
    ranked = rank_within(w, ["http_remote_addr", "window_start"], ["log_ts", "id"], rows_per_bucket)
    n = F.col("rank")
    return ranked.select(
        "id", "http_remote_addr", "window_start", F.col("rank").alias("request_number"),
        F.when(n > cfg.rate_limit, "rejected").when(n > cfg.rate_notice, "high_rate").otherwise("ok").alias("decision"))

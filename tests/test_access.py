"""Access-log operators: skew-safe ranking and rate classes."""

import datetime as dt
import random

from pyspark.sql import functions as F

from logspark.operators import access as AC

T0 = dt.datetime(2024, 1, 1)


def test_rank_within_hot_group_matches_row_number(spark):
    rnd = random.Random(3)
    rows = [(i, T0 + dt.timedelta(seconds=rnd.randint(0, 50)), "hot" if i % 20 else "cold") for i in range(4000)]
    df = spark.createDataFrame(rows, "id bigint, log_ts timestamp_ntz, client string")
    got = {r.id: r.rank for r in AC.rank_within(df, ["client"], ["log_ts", "id"], rows_per_bucket=100).collect()}
    want = {}
    for c in ("hot", "cold"):
        items = sorted((t, i) for i, t, cl in rows if cl == c)
        for k, (_, i) in enumerate(items, 1):
            want[i] = k
    assert got == want


def test_rate_limit_classes_one_client_flood(spark):
    # 106 requests from one client in one minute: 50 ok, 50 high, 6 rejected
    rows = [(i, T0 + dt.timedelta(milliseconds=100 * i), "10.0.0.1:5000") for i in range(106)]
    acc = spark.createDataFrame(rows, "id bigint, log_ts timestamp_ntz, http_remote_addr string")
    d = {r.decision: r["count"] for r in AC.rate_limit_requests(acc, "1 minute").groupBy("decision").count().collect()}
    assert d == {"ok": 50, "high_rate": 50, "rejected": 6}
    agg = AC.rate_limit_decisions(acc, "1 minute").first()
    assert (agg.requests, agg.ok, agg.high_rate, agg.rejected) == (106, 50, 50, 6)
    first_rejected = (AC.rate_limit_requests(acc, "1 minute").filter("decision = 'rejected'")
                      .agg(F.min("id")).first()[0])
    assert first_rejected == 100


def test_suspicious_requests(spark):
    rows = [(1, T0, "GET", "/a%20b", 200, 5, "1.1.1.1", "ua"), (2, T0, "GET", "/ok/path", 200, 5, "1.1.1.1", ""),
            (3, T0, "GET", "/health", 200, 5, "1.1.1.1", ""), (4, T0, "GET", "/fine", 200, 5, "1.1.1.1", "ua")]
    acc = spark.createDataFrame(rows, "id bigint, log_ts timestamp_ntz, http_method string, http_path string, "
                                      "http_status_code int, duration_ms bigint, http_remote_addr string, "
                                      "http_user_agent string")
    got = {r.id: (r.empty_user_agent, r.url_encoding) for r in AC.access_suspicious(acc).collect()}
    assert got == {1: (False, True), 2: (True, False)}


def test_access_severity_with_size_columns(spark):
    rows = [(1, 200, 10, 100, 1000), (2, 404, 20, 50, 10), (3, 503, 30, 0, 5), (4, 201, 40, 300, 3000)]
    acc = spark.createDataFrame(rows, "id bigint, http_status_code int, duration_ms bigint, "
                                      "content_length bigint, response_size bigint")
    got = {r.severity: r for r in AC.access_severity(acc).collect()}
    assert (got["info"].requests, got["info"].total_response_size, got["info"].avg_content_length) == (2, 4000, 200.0)
    assert (got["warn"].requests, got["error"].avg_duration_ms) == (1, 30.0)


def _ranks_and_gaps(spark, prune):
    from logspark.operators import ml as ML
    n = 100_000
    df = spark.range(n).selectExpr(
        "id", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, cast(hash(id) % 40000 AS int)) AS log_ts",
        "if(id % 10 = 0, concat('c', id % 30), 'hot') AS source", "'error' AS level", "'m' AS message")
    ranked = AC.rank_within(df, ["source"], ["log_ts", "id"], rows_per_bucket=5_000)
    gaps = ML.error_gaps(df, rows_per_bucket=5_000)
    want = df.selectExpr("id", "row_number() OVER (PARTITION BY source ORDER BY log_ts, id) AS want_rank",
                         "timestampdiff(MICROSECOND, lag(log_ts) OVER (PARTITION BY source ORDER BY log_ts, id), log_ts) / 1e6 AS want_gap")
    if prune:
        ranked, gaps = ranked.select("id", "rank"), gaps.select("id", "gap_seconds")
    bad_ranks = ranked.join(want, "id").filter("rank <> want_rank").count()
    bad_gaps = gaps.join(want, "id").filter("NOT (gap_seconds <=> want_gap)").count()
    return ranked.count(), gaps.count(), bad_ranks, bad_gaps


def test_ranks_and_gaps_do_not_depend_on_the_planner(spark):
    settings = {"spark.sql.exchange.reuse": ("true", "false"), "spark.sql.adaptive.enabled": ("true", "false")}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for reuse in settings["spark.sql.exchange.reuse"]:
            for adaptive in settings["spark.sql.adaptive.enabled"]:
                spark.conf.set("spark.sql.exchange.reuse", reuse)
                spark.conf.set("spark.sql.adaptive.enabled", adaptive)
                for prune in (False, True):
                    assert _ranks_and_gaps(spark, prune) == (100_000, 100_000, 0, 0), (reuse, adaptive, prune)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)

"""Ingest validation: the handler's cases and the accept/reject invariant."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from logspark.sources import ingest as IG
from logspark.sources.tables import load_raw_events, read_table

CASES = [
    ('{"message":"Test log message","level":"info","source":"test-service","timestamp":"2023-01-01T12:00:00Z"}',
     None, "structured", "info", "test-service"),
    ('{"log":"Legacy log message"}', None, "legacy", "info", "legacy_api"),
    ("{invalid json}", IG.INVALID_JSON, None, None, None),
    ('{"timestamp":"2023-01-01T12:00:00Z"}', IG.MISSING_FIELDS, None, None, None),
    ('{"message":"","level":"info","source":"test-service"}', IG.EMPTY_MESSAGE, None, None, None),
    ('{"message":"x","level":"Warn"}', IG.INVALID_LEVEL, None, None, None),
    ('{"message":"x"}', IG.INVALID_LEVEL, None, None, None),
    ('{"message":"x","level":"ERROR"}', None, "structured", "ERROR", "unknown"),
    ('{"message":"x","level":"warn","timestamp":"2024-01-15 10:30:00"}', IG.INVALID_STRUCTURED, None, None, None),
    ('{"message":42,"level":"warn"}', IG.INVALID_STRUCTURED, None, None, None),
    ('{"message":"x","level":"warn","id":"seven"}', IG.INVALID_STRUCTURED, None, None, None),
    ('{"message":null,"level":"warn"}', IG.EMPTY_MESSAGE, None, None, None),
    ('{"log":7}', IG.HANDLER_FAILED, None, None, None),
    ('{"log":""}', IG.EMPTY_MESSAGE, None, None, None),
    ("null", IG.MISSING_FIELDS, None, None, None),
    ("[1,2]", IG.INVALID_JSON, None, None, None),
    ('{"message":"x","level":"info","source":"' + "s" * 101 + '"}', IG.STORE_FAILED, None, None, None),
    ('{"message":"' + "m" * 10000 + '","level":"info"}', None, "structured", "info", "unknown"),
]


@pytest.mark.parametrize("payload,reason,route,level,source", CASES)
def test_handler_cases(spark, payload, reason, route, level, source):
    raw = spark.createDataFrame([(1, payload)], "id bigint, payload string")
    r = IG.route_payloads(raw).first()
    assert (r.reason, r.route) == (reason, route)
    if reason is None:
        assert (r.level, r.source) == (level, source)


def test_timestamps(spark):
    raw = spark.createDataFrame([(1, '{"message":"a","level":"info","timestamp":"2024-01-15T10:30:00+02:00"}'),
                                 (2, '{"log":"b"}')], "id bigint, payload string")
    rows = {r.id: r.log_ts for r in IG.accepted(IG.route_payloads(raw, ingest_ts="2030-01-01 00:00:00")).collect()}
    assert rows == {1: dt.datetime(2024, 1, 15, 8, 30), 2: dt.datetime(2030, 1, 1)}


def test_accepted_plus_rejected_is_input(spark):
    routed = IG.route_payloads(load_raw_events(spark, "/root/testdata/sf0.001"))
    n = routed.count()
    assert IG.accepted(routed).count() + IG.rejects(routed).count() == n
    counts = {r.outcome: r["count"] for r in IG.route_counts(routed).collect()}
    assert sum(counts.values()) == n


def test_text_lines_keep_whole_texts(spark):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    lines = IG.text_lines(docs)
    total_chars = docs.select(F.sum(F.length("text"))).first()[0]
    kept = lines.select(F.sum(F.length("message"))).first()[0]
    newlines = docs.select(F.sum(F.length("text") - F.length(F.regexp_replace("text", "\n", "")))).first()[0]
    assert kept + newlines == total_chars


def test_service_log_readers_tolerate_malformed_lines(spark):
    from logspark.operators import access as AC
    from logspark.sources import applog as AP
    lines = spark.createDataFrame(
        [(1, "[2024-01-01 00:00:00] INFO [svc/http] f.go:12 fn - ok [request=r1] fields={\"duration_ms\":150}"),
         (2, "not a service log line at all"),
         (3, "[2024-01-01 00:00:01] WARN [svc/http] :0  - slow fields={\"duration_ms\":\"abc\"}")],
        "id bigint, line string")
    t = {r.id: r for r in AP.parse_text(lines).collect()}
    assert (t[1].level, t[1].line, t[1].request_id, t[1].fields["duration_ms"]) == ("INFO", 12, "r1", "150")
    assert t[2].line is None and t[2].level == ""
    assert t[3].message == "slow" and t[3].fields["duration_ms"] == "abc"
    parsed = AP.parse_text(lines).withColumn("request_id", F.coalesce("request_id", F.lit("-")))
    slow = {r.id for r in AC.slow_entries(parsed).collect()}
    assert slow == {1}
    js = spark.createDataFrame([(1, '{"message":"m","level":"INFO","fields":{"duration_ms":"x"}}'), (2, "{broken")],
                               "id bigint, line string")
    j = {r.id: r for r in AP.parse_json(js).collect()}
    assert j[1].message == "m" and j[1]._corrupt is None and j[2]._corrupt == "{broken"


def test_lower_case_time_letters_are_rejected(spark):
    from logspark.sources import ingest as IG
    rows = [(1, '{"message":"m","level":"info","timestamp":"2024-01-15T10:30:00Z"}'),
            (2, '{"message":"m","level":"info","timestamp":"2024-01-15t10:30:00Z"}'),
            (3, '{"message":"m","level":"info","timestamp":"2024-01-15T10:30:00z"}')]
    out = IG.route_payloads(spark.createDataFrame(rows, "id bigint, payload string")).collect()
    assert {r.id: r.reason for r in out} == {1: None, 2: IG.INVALID_STRUCTURED, 3: IG.INVALID_STRUCTURED}


def test_jdbc_ranges_follow_the_ids_of_the_table():
    from logspark.sources.tables import JdbcSource
    source = JdbcSource("jdbc:postgresql://db/logs", user="u", password="p", num_partitions=8)
    assert source.ranges(100, 899) == {"partitionColumn": "id", "lowerBound": "100", "upperBound": "900", "numPartitions": "8"}
    assert source.ranges(5, 6)["numPartitions"] == "2" and source.ranges(0, 0)["numPartitions"] == "1"
    assert source.options()["user"] == "u" and "user" not in JdbcSource("jdbc:postgresql://db/logs").options()


def test_a_hot_day_is_written_by_several_tasks(spark, tmp_path):
    import os

    from logspark.sinks.writers import write_logs
    logs = spark.range(5000).selectExpr(
        "id", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, cast(id * 17 AS int)) AS log_ts",
        "'info' AS level", "'m' AS message", "'s' AS source")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_logs(logs, f"{tmp_path}/logs")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    day = [f for f in os.listdir(f"{tmp_path}/logs/date=2024-01-01") if f.endswith(".parquet")]
    assert len(day) >= 3 and spark.read.parquet(f"{tmp_path}/logs").count() == 5000

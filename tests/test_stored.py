"""Stored tables: history, log table, log files; payload names; episodes."""

import datetime as dt
import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from logspark.operators import episodes as EP
from logspark.operators import reliability as RL
from logspark.plans import history as H
from logspark.sinks import writers as W
from logspark.sources import applog as AP
from logspark.sources import ingest as IG

T0 = dt.datetime(2024, 1, 1, 10)
LOGS = "id bigint, log_ts timestamp_ntz, level string, message string, source string"


def make(spark, rows):
    return spark.createDataFrame(rows, LOGS)


def days(spark, n=4):
    rows = [(100 * d + i, T0 + dt.timedelta(days=d, minutes=17 * i), ("error", "info", "WARN", None)[(i + d) % 4],
             f"query took {i * 700}ms", f"s{i % (d + 2)}") for d in range(n) for i in range(30)]
    return rows + [(9999, None, "error", "no time", "x")]


def test_history_equals_reports_of_all_earlier_days(spark, tmp_path):
    rows, path = days(spark), str(tmp_path / "h")
    H.refresh(make(spark, rows), path)
    out = H.runs(spark, path).orderBy("day").collect()
    assert len(out) == 4 and out[0]["error_rate_change"] is None
    for r in out:
        logs = make(spark, [x for x in rows if x[1] and x[1].date() <= r["day"]])
        want = RL.reliability_score(logs).first()
        assert r["score"] == pytest.approx(want["score"]) and r["grade"] == want["grade"]
        assert r["total_logs"] == logs.count() and r["new_logs"] == 30


def test_a_day_written_again_leaves_the_others(spark, tmp_path):
    rows, path = days(spark), str(tmp_path / "h")
    H.refresh(make(spark, rows), path)
    files = lambda: {p: os.path.getmtime(p) for p in glob.glob(f"{path}/day=*/*.parquet")}
    before, runs = files(), sorted(map(str, H.runs(spark, path).collect()))
    H.refresh(make(spark, rows), path, [dt.date(2024, 1, 3)])
    assert sorted(map(str, H.runs(spark, path).collect())) == runs
    kept = {p for p in before if p in files()}
    assert {p for p in before if "day=2024-01-03" not in p} == kept
    late = [*rows, (10_000, T0 + dt.timedelta(days=1), "fatal", "late", "s0")]
    H.refresh(make(spark, late), path, [dt.date(2024, 1, 2)])
    assert [r["total_logs"] for r in H.runs(spark, path).orderBy("day").collect()] == [30, 61, 91, 121]


def test_a_hot_hour_is_written_by_many_tasks_and_a_replay_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "logs")
    rows = [(i, T0 + dt.timedelta(milliseconds=i), "info", "m", "s") for i in range(4000)] + [(9000, None, "info", "m", "s")]
    for _ in range(2):
        W.write_logs(make(spark, rows).repartition(6), path, unit="batch-1", files=8)
    W.write_logs(make(spark, [(9001, T0, "info", "m", "s")]), path, unit="batch-2")
    stored = W.read_written_logs(spark, path)
    assert sorted(r["id"] for r in stored.collect()) == [*range(4000), 9000, 9001]
    sizes = stored.filter("id < 4000").groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n"), F.min("id"), F.max("id")).collect()
    assert len(sizes) >= 6 and max(r["n"] for r in sizes) < 1500
    spans = sorted((r[2], r[3]) for r in sizes)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))   # each file is a stretch of time


def test_records_over_several_lines_and_splits(spark, tmp_path):
    blocks = ["a line before any header"]
    for i in range(200):
        blocks.append(f"[2024-01-01 10:00:{i % 60:02d}] ERROR [svc/db] store.go:{i} Store - failed {i} [request=r{i}] fields={{\"n\": \"{i}\"}}")
        if i % 3 == 0:
            blocks += ["Traceback (most recent call last):", "", "[not] a header", f"store.Timeout: after {i} tries"]
        if i % 50 == 1:
            blocks += ["x" * 700]
    for name in ("one", "two"):
        (tmp_path / f"{name}.log").write_text("\n".join(blocks) + "\n")
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("512", "100000000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            out = AP.read_text_log(spark, str(tmp_path)).collect()
            entries = [r for r in out if r["message"]]
            assert len(out) == 402 and len(entries) == 400
            for r in entries:
                i = int(r["message"].split()[1])
                own = []
                if i % 3 == 0:
                    own += ["Traceback (most recent call last):", "", "[not] a header", f"store.Timeout: after {i} tries"]
                if i % 50 == 1:
                    own += ["x" * 700]
                assert r["traceback"] == ("\n".join(own) if own else None) and r["line"] == i and r["fields"]["n"] == str(i)
                if i % 3 == 0 and i % 50 != 1:
                    assert (r["exception_type"], r["exception_message"]) == ("store.Timeout", f"after {i} tries")
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


CASES = [
    ('{"message":"a","Level":"INFO"}', None, "a", "INFO", "unknown"),
    ('{"message":"a","level":"info","LEVEL":"bad"}', None, "a", "info", "unknown"),
    ('{"level":"info","message":"a","Message":"b"}', None, "a", "info", "unknown"),
    ('{"message":null,"MESSAGE":"x","level":"warn"}', None, "x", "warn", "unknown"),
    ('{"message":"a","level":"info","SOURCE":"s"}', None, "a", "info", "s"),
    ('{"message":"a","level":"info","Source":7,"source":"s"}', IG.INVALID_STRUCTURED, None, None, None),
    ('{"MESSAGE":"a","level":"info"}', IG.MISSING_FIELDS, None, None, None),
    ('{"message":"a","level":"info","TIMESTAMP":"yesterday"}', IG.INVALID_STRUCTURED, None, None, None),
    ('{"message":"a","message":"b","level":"info"}', None, "b", "info", "unknown"),
    ('{"message":7,"message":"b","level":"info"}', None, "b", "info", "unknown"),
    ('{"level":"info","level":null,"message":"b"}', IG.INVALID_LEVEL, None, None, None),
    ('{"log":"x","log":"y"}', None, "y", "info", "legacy_api"),
    ('{"Log":"x"}', IG.MISSING_FIELDS, None, None, None),
    ('{"message":"a","level":"info","ID":"seven"}', IG.INVALID_STRUCTURED, None, None, None),
]


def test_field_names_in_any_case(spark):
    raw = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "id bigint, payload string")
    out = {r["id"]: r for r in IG.route_payloads(raw).collect()}
    for i, (payload, reason, message, level, source) in enumerate(CASES):
        assert json.loads(payload) and out[i]["reason"] == reason, payload
        if reason is None:
            assert (out[i]["message"], out[i]["level"], out[i]["source"]) == (message, level, source), payload


def test_episodes(spark):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    rows = [("v", None, at(0), at(10), 5, 0.7), ("v", None, at(60), at(70), 6, 0.9), ("v", None, at(131), at(141), 1, 0.8),
            ("v", "s", at(60), at(70), 2, 0.5), ("w", None, at(0), at(500), 1, 0.6), ("w", None, at(20), at(30), 1, 0.6),
            ("w", None, at(555), at(560), 1, 0.9)]
    df = spark.createDataFrame(rows, "type string, source string, started timestamp_ntz, ended timestamp_ntz, count bigint, confidence double")
    got = sorted((r["type"], r["source"] or "", r["started"], r["ended"], r["count"], r["confidence"], r["merged_count"])
                 for r in EP.episodes(df).collect())
    assert got == [("v", "", at(0), at(70), 11, 0.9, 2), ("v", "", at(131), at(141), 1, 0.8, None), ("v", "s", at(60), at(70), 2, 0.5, None),
                   ("w", "", at(0), at(560), 3, 0.9, 3)]


def test_stored_days_have_merged_episodes(spark):
    import __spark_entry__ as E

    out = E.queries()["anomaly_episodes"](spark, "/root/testdata/sf0.001").collect()
    assert any(r["merged_count"] for r in out) and any(r["merged_count"] is None for r in out)

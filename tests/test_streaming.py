"""Streaming jobs produce the same rows as the batch queries."""

import os
import uuid

from pyspark.sql import functions as F

import __spark_entry__ as E
from logspark.config import checkpoint_dir
from logspark.sources import tables as TB
from logspark.streaming import jobs as ST

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_stream_ingest_equals_batch(spark):
    q = E.queries()
    assert _rows(q["stream_ingest"](spark, SF)) == _rows(q["ingest_accepted"](spark, SF).select(
        "id", "log_ts", "level", "message", "source", "route"))


def test_stream_ingest_is_idempotent_on_rerun(spark):
    base = os.path.join(checkpoint_dir(spark), "t", uuid.uuid4().hex)
    schema = TB.read_table(spark, SF, "events").schema
    for _ in range(2):     # the second run resumes from the checkpoint and adds nothing
        s = ST.read_stream(spark, SF, schema, glob="events.parquet")
        ST.ingest_stream(TB.raw_events_from_events(s), f"{base}/out", f"{base}/ck").awaitTermination()
    acc = spark.read.parquet(f"{base}/out/accepted")
    assert acc.count() == acc.select("id").distinct().count()


def test_stream_windows_subset_of_batch(spark):
    q = E.queries()
    s = q["stream_window_counts"](spark, SF)
    b = q["volume_by_window"](spark, SF).select("window_start", "volume", "error_count")
    assert s.count() > 0
    assert s.select("window_start", "volume", "error_count").subtract(b).count() == 0


def test_monitor_writes_status(spark):
    st = E.queries()["stream_monitor"](spark, SF).collect()
    assert len(st) >= 1 and st[0].total_logs > 0


def test_monitor_with_processing_time_trigger(spark):
    base = os.path.join(checkpoint_dir(spark), "t", uuid.uuid4().hex)
    schema = TB.read_table(spark, SF, "events").schema
    logs = TB.logs_from_events(ST.read_stream(spark, SF, schema, glob="events.parquet"))
    q = ST.monitor_stream(logs, f"{base}/out", f"{base}/ck", available_now=False, interval="1 second")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    st = spark.read.parquet(f"{base}/out/status").collect()
    assert sum(r.total_logs for r in st) == TB.load_logs(spark, SF).count()


def test_streams_and_stats_read_folder_tables_and_appended_rows(spark, tmp_path):
    """A table of many part files, and one that grows between two calls."""
    import duckdb

    events = spark.read.parquet(f"{SF}/events.parquet")
    half = events.filter("event_id % 2 = 0")
    half.repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    q = E.queries()
    before = q["table_stats"](spark, str(tmp_path)).collect()
    events.filter("event_id % 2 = 1").repartition(3).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    assert q["table_stats"](spark, str(tmp_path)).collect() != before
    assert q["table_stats"](spark, str(tmp_path)).collect() == q["table_stats"](spark, SF).collect()
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    for name in ("stream_ingest", "stream_window_counts", "stream_rate_limit"):
        got = q[name](spark, str(tmp_path)).count()
        assert got == con.execute(f"SELECT count(*) FROM ({E.oracle_sql()[name]})").fetchone()[0] > 0, name

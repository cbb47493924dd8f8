"""Streams that carry state: exact over restarts, retries and late rows."""

import datetime as dt
import random

import pytest

from logspark.streaming import carried as CS

T0 = dt.datetime(2024, 1, 1, 10)
SCHEMA = "id bigint, log_ts timestamp_ntz, http_remote_addr string"


def put(spark, path, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def read(spark, path, schema=SCHEMA):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def numbers(rows):
    """The n-th of each client and minute by (time, id)."""
    out, seen = {}, {}
    for i, ts, who in sorted(rows, key=lambda r: (r[1], r[0])):
        key = who, ts.replace(second=0, microsecond=0)
        seen[key] = seen.get(key, 0) + 1
        out[i] = seen[key], "rejected" if seen[key] > 100 else "high_rate" if seen[key] > 50 else "ok"
    return out


def flood(n, seed):
    rng = random.Random(seed)
    rows = [(i, T0 + dt.timedelta(milliseconds=300 * i), "hot" if i % 3 else rng.choice(["a", None])) for i in range(n)]
    rows.sort(key=lambda r: r[1] + dt.timedelta(seconds=rng.randint(0, 20)))   # out of order by 20 s at most
    return rows


def test_numbers_across_batches_and_a_restart(spark, tmp_path):
    rows, source, out = flood(900, 1), str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        CS.request_decisions_stream(read(spark, source), out, str(tmp_path / "ck"), "1 minute", dt.timedelta(seconds=25)).awaitTermination()

    for part in (rows[:250], rows[250:500]):
        put(spark, source, part)
    run()
    some = CS.request_decisions(spark, out).count()
    assert 0 < some < 500                                  # some still wait
    put(spark, source, rows[500:])
    run()                                                  # a new query from the same checkpoint
    run()                                                  # nothing new: adds nothing
    got = {r["id"]: (r["request_number"], r["decision"]) for r in CS.request_decisions(spark, out, "1 minute", waiting=True).collect()}
    want = numbers(rows)
    assert got == want and {d for _, d in want.values()} == {"ok", "high_rate", "rejected"}
    done = [r["id"] for r in CS.request_decisions(spark, out).collect()]
    assert len(done) == len(set(done)) and all(want[i] == got[i] for i in done)
    # counts of closed windows are gone
    state = CS.BatchState(spark, f"{out}/_state")
    kept = state.read(max(state.batches()), "counts", CS.COUNTS).collect()
    newest = max(r[1] for r in rows)
    assert kept and all(r["window_start"] + dt.timedelta(minutes=1) > newest - dt.timedelta(seconds=25) for r in kept)
    assert len(state.batches()) == 2


def test_a_batch_run_again_replaces_its_first_attempt(spark, tmp_path):
    """As after a failure between the sink and the commit: the last batch's
    commit is taken back, so Spark runs it again."""
    rows, source, out, ck = flood(300, 2), str(tmp_path / "in"), str(tmp_path / "out"), tmp_path / "ck"
    for part in (rows[:150], rows[150:]):
        put(spark, source, part)
    for _ in range(2):
        CS.request_decisions_stream(read(spark, source), out, str(ck), "1 minute", dt.timedelta(0)).awaitTermination()
        first = sorted(tuple(r) for r in CS.request_decisions(spark, out).collect())
        for name in ("1", ".1.crc"):
            (ck / "commits" / name).unlink(missing_ok=True)
    assert sorted(tuple(r) for r in CS.request_decisions(spark, out).collect()) == first and len(first) == 300


def test_late_requests_are_numbered_behind(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, source, [(i, T0 + dt.timedelta(seconds=i), "a") for i in range(5)])
    put(spark, source, [(9, T0 + dt.timedelta(seconds=1), "a"), (10, None, "a")])
    CS.request_decisions_stream(read(spark, source), out, str(tmp_path / "ck"), "1 minute", dt.timedelta(0)).awaitTermination()
    assert {r["id"]: r["request_number"] for r in CS.request_decisions(spark, out).collect()} == {0: 1, 1: 2, 2: 3, 3: 4, 4: 5, 9: 6}


def test_report_on_the_newest_rows_of_every_batch(spark, tmp_path):
    from logspark.plans import report as RP

    schema = "id bigint, log_ts timestamp_ntz, source string, level string, message string"
    rng = random.Random(3)
    rows = [(i, T0 + dt.timedelta(seconds=rng.randint(0, 5000)), f"s{i % 4}", rng.choice(["error", "info", "warn"]), f"took {i * 10}ms")
            for i in range(60)]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(3):
        put(spark, source, rows[20 * k:20 * k + 20], schema)
    CS.recent_report_stream(read(spark, source, schema), out, str(tmp_path / "ck"), newest=25).awaitTermination()
    for r in spark.read.parquet(f"{out}/reports").collect():
        upto = 20 * r["batch_id"] + 20
        newest = sorted(rows[:upto], key=lambda x: (x[1], x[0]))[-25:]
        want = RP.report(spark.createDataFrame(newest, schema)).first()
        assert r["error_analysis"].total_logs == min(25, upto)
        for part in ("summary", "error_analysis", "performance_analysis", "security_analysis"):
            for name, value in want[part].asDict().items():
                assert r[part][name] == (pytest.approx(value) if isinstance(value, float) else value)

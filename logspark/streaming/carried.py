"""Streaming jobs that carry rows from one micro-batch to the next.

Their state is tables, one folder per micro-batch: batch n reads what the
newest earlier batch left, and overwrites its own folder and its own
``batch_id=`` output.  A batch that Spark runs again after a failure or a
restart thus starts from the same state and replaces its first attempt.
State is worked on by joins and aggregates like any other table, so a client
that sends a third of all requests is no single task's.

* :func:`request_decisions_stream` - the number of every request in its
  client's window and the decision, in event-time order.
* :func:`recent_report_stream` - the comprehensive report on the newest
  rows after every batch.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..operators import access as AC
from ..plans import report as RP
from ..sinks.scratch import remove
from ..sources.scans import ts_lit
from .jobs import _trigger


class BatchState:
    """Tables of one job by batch: ``root/batch=<n>/<name>``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _path(self, batch_id: int, name: str = "") -> str:
        return f"{self.root}/batch={batch_id}" + (f"/{name}" if name else "")

    def batches(self) -> list[int]:
        """The batches that have a finished state."""
        sc = self.spark.sparkContext
        folder = sc._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = folder.getFileSystem(sc._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        names = [(s.getPath(), s.getPath().getName()) for s in fs.listStatus(folder)]
        done = sc._jvm.org.apache.hadoop.fs.Path
        return sorted(int(n.split("=")[1]) for p, n in names if n.startswith("batch=") and fs.exists(done(p, "done/_SUCCESS")))

    def before(self, batch_id: int) -> int | None:
        return max((n for n in self.batches() if n < batch_id), default=None)

    def read(self, batch_id: int | None, name: str, schema) -> DataFrame:
        if batch_id is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._path(batch_id, name))

    def write(self, df: DataFrame, batch_id: int, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self._path(batch_id, name))
        return self.spark.read.schema(df.schema).parquet(self._path(batch_id, name))

    def finish(self, batch_id: int) -> None:
        """Mark a batch's state as whole and delete those that no retry reads:
        all before the one that this batch has read."""
        self.spark.range(1).write.mode("overwrite").parquet(self._path(batch_id, "done"))
        for old in [n for n in self.batches() if n < batch_id][:-1]:
            remove(self.spark, self._path(old))


REQUEST = "id bigint, log_ts timestamp_ntz, http_remote_addr string"
COUNTS = "http_remote_addr string, window_start timestamp_ntz, requests bigint"
DECISION = ("id", "http_remote_addr", "window_start", "request_number", "decision")


def _windowed(requests: DataFrame, window: str) -> DataFrame:
    return requests.select("id", "log_ts", "http_remote_addr", F.window("log_ts", window).start.alias("window_start"))


def _numbered(requests: DataFrame, counts: DataFrame, window: str, cfg: EngineConfig) -> DataFrame:
    """The requests' numbers behind those that their windows had already."""
    ranked = AC.rank_within(_windowed(requests, window), ["http_remote_addr", "window_start"], ["log_ts", "id"])
    same = (F.col("r.http_remote_addr").eqNullSafe(F.col("c.http_remote_addr"))
            & F.col("r.window_start").eqNullSafe(F.col("c.window_start")))
    n = F.col("rank") + F.coalesce("requests", F.lit(0))
    joined = ranked.alias("r").join(counts.alias("c"), same, "left").select("r.*", n.alias("request_number"))
    nr = F.col("request_number")
    decision = F.when(nr > cfg.rate_limit, "rejected").when(nr > cfg.rate_notice, "high_rate").otherwise("ok")
    return joined.select("id", "http_remote_addr", "window_start", "request_number", decision.alias("decision"))


def request_decisions_stream(access: DataFrame, out_dir: str, checkpoint: str, window: str | None = None,
                             delay: _dt.timedelta = _dt.timedelta(minutes=1), cfg: EngineConfig = DEFAULT,
                             available_now: bool = True, interval: str | None = None):
    """Number every request in its client's window and decide: ok, high_rate
    from the 51st, rejected from the 101st.

    Requests wait until the newest one seen is ``delay`` later, so those that
    arrive out of order within it are numbered by (time, id) all the same,
    across micro-batches and restarts.  One that comes later still gets the
    next number of its window while that is open, and starts anew when the
    window's count has been dropped (window end before newest - ``delay``).
    Requests without a time have no window and get no decision.

    ``out_dir/decisions``: DECISION columns per batch; ``out_dir/_state``:
    per-window counts of open windows and the waiting requests.
    """
    window = window or cfg.rate_window
    state = BatchState(access.sparkSession, f"{out_dir}/_state")

    def sink(batch: DataFrame, batch_id: int):
        before = state.before(batch_id)
        columns = [f.strip().split(" ")[0] for f in REQUEST.split(",")]
        rows = batch.select(*columns).unionByName(state.read(before, "waiting", REQUEST))
        rows = state.write(rows, batch_id, "rows")         # the source is read once
        marks = [m for m in (rows.agg(F.max("log_ts")).first()[0],
                             state.read(before, "mark", "newest timestamp_ntz").agg(F.max("newest")).first()[0]) if m is not None]
        newest = max(marks, default=None)
        cut = ts_lit(newest - delay) if newest is not None else F.lit(None).cast("timestamp_ntz")
        waits = F.coalesce(F.col("log_ts") > cut, F.lit(False))
        counts = state.read(before, "counts", COUNTS)
        released = rows.filter(~waits)
        _numbered(released, counts, window, cfg).write.mode("overwrite").parquet(f"{out_dir}/decisions/batch_id={batch_id}")
        added = _windowed(released, window).groupBy("http_remote_addr", "window_start").agg(F.count(F.lit(1)).alias("requests"))
        end = F.window(F.col("window_start"), window).end
        summed = counts.unionByName(added).groupBy("http_remote_addr", "window_start").agg(F.sum("requests").alias("requests"))
        still = summed.select("*", end.alias("end")).filter(F.coalesce(F.col("end") > cut, F.lit(True))) if newest is not None else summed
        state.write(still.select("http_remote_addr", "window_start", "requests"), batch_id, "counts")
        state.write(rows.filter(waits), batch_id, "waiting")
        state.write(state.spark.createDataFrame([(newest,)], "newest timestamp_ntz"), batch_id, "mark")
        state.finish(batch_id)

    w = access.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return _trigger(w, available_now, interval).start()


def request_decisions(spark: SparkSession, out_dir: str, window: str | None = None, waiting: bool = False,
                      cfg: EngineConfig = DEFAULT) -> DataFrame:
    """The decisions that a stream has written; with ``waiting`` also those
    that its waiting requests get if nothing earlier arrives."""
    done = spark.read.parquet(f"{out_dir}/decisions").select(*DECISION)
    if not waiting:
        return done
    state = BatchState(spark, f"{out_dir}/_state")
    last = max(state.batches(), default=None)
    rest = _numbered(state.read(last, "waiting", REQUEST), state.read(last, "counts", COUNTS), window or cfg.rate_window, cfg)
    return done.unionByName(rest)


def recent_report_stream(logs: DataFrame, out_dir: str, checkpoint: str, newest: int = 100, cfg: EngineConfig = DEFAULT,
                         available_now: bool = True, interval: str | None = "30 seconds"):
    """After every batch, the comprehensive report on the ``newest`` rows seen
    so far (by time, then id), as the monitoring loop analyses them: one row
    per batch in ``out_dir/reports``.  The state is those rows."""
    state = BatchState(logs.sparkSession, f"{out_dir}/_state")

    def sink(batch: DataFrame, batch_id: int):
        before = state.read(state.before(batch_id), "newest", batch.schema)
        order = [F.col("log_ts").desc_nulls_last(), F.col("id").desc()]
        held = state.write(batch.unionByName(before).orderBy(*order).limit(newest), batch_id, "newest")
        RP.report(held, cfg).write.mode("overwrite").parquet(f"{out_dir}/reports/batch_id={batch_id}")
        state.finish(batch_id)

    w = logs.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return _trigger(w, available_now, interval).start()

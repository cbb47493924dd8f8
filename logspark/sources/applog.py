"""Service logs: render access rows as the service's log entries (JSON line
or text line) and read such lines back into typed columns.

The text layout is ``[ts] LEVEL [service/component] file:line function - message
[trace=..] [request=..] [user=..] fields={json}``; the JSON layout is one
object per line with the same keys plus a nested ``fields`` object.  Both
readers are single-pass column expressions (``regexp_extract`` /
``from_json``) so they scale with the file splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import levels as L
from ..operators import quantiles as Q
from ..schema import APP_LOG_SCHEMA

SERVICE, COMPONENT = "log-ingestion", "http"

# fixed values: messages the request middleware logs per outcome
COMPLETED = "HTTP request completed"
CLIENT_ERROR = "HTTP request failed with client error"
SERVER_ERROR = "HTTP request failed with server error"

TEXT_LINE = (r"^\[([^\]]*)\] (\S+) \[([^/\]]*)/([^\]]*)\] (\S*):(\d+) (\S*) - (.*?)"
             r"(?: \[trace=([^\]]*)\])?(?: \[request=([^\]]*)\])?(?: \[user=([^\]]*)\])?(?: fields=(\{.*\}))?$")


def access_entries(acc: DataFrame) -> DataFrame:
    """One service-log entry per request (APP_LOG columns)."""
    sev = L.status_severity(F.col("http_status_code"))
    fields = F.struct(F.col("duration_ms"), F.col("http_method"), F.col("http_path"),
                      F.col("http_remote_addr"), F.col("http_status_code").cast("bigint").alias("http_status_code"),
                      F.col("http_user_agent"))
    return acc.select(
        "id",
        F.date_format("log_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.upper(sev).alias("level"),
        F.when(sev == "error", SERVER_ERROR).when(sev == "warn", CLIENT_ERROR).otherwise(COMPLETED).alias("message"),
        F.lit(SERVICE).alias("service"), F.lit(COMPONENT).alias("component"),
        F.concat(F.lit("req-"), F.col("id").cast("string")).alias("request_id"),
        fields.alias("fields"))


def render_text(entries: DataFrame) -> DataFrame:
    """``(id, line)`` in the text layout (file/line/function unknown: ':0')."""
    ts = F.regexp_replace(F.regexp_replace("timestamp", "T", " "), "Z$", "")
    line = F.concat(
        F.lit("["), ts, F.lit("] "), F.col("level"), F.lit(" ["), F.col("service"), F.lit("/"), F.col("component"),
        F.lit("] :0  - "), F.col("message"),
        F.concat(F.lit(" [request="), F.col("request_id"), F.lit("]")),
        F.concat(F.lit(" fields="), F.to_json("fields")))
    return entries.select("id", line.alias("line"))


def render_json(entries: DataFrame) -> DataFrame:
    cols = [c for c in ("timestamp", "level", "message", "service", "component", "request_id", "fields")]
    return entries.select("id", F.to_json(F.struct(*cols)).alias("line"))


def parse_text(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Split text-layout lines into typed columns; fields stay a string map."""
    ln = F.col(line_col)
    g = lambda i: F.regexp_extract(ln, TEXT_LINE, i)
    nz = lambda c: F.nullif(c, F.lit(""))
    return lines.select(
        *[c for c in lines.columns if c != line_col],
        g(1).alias("timestamp"), g(2).alias("level"), g(3).alias("service"), g(4).alias("component"),
        g(5).alias("file"), g(6).try_cast("int").alias("line"), g(7).alias("function"), g(8).alias("message"),
        nz(g(9)).alias("trace_id"), nz(g(10)).alias("request_id"), nz(g(11)).alias("user_id"),
        F.from_json(nz(g(12)), "map<string,string>").alias("fields"))


def parse_json(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """JSON lines to APP_LOG columns; unparsable lines keep a null message
    and the raw text in ``_corrupt``."""
    parsed = F.from_json(F.col(line_col), APP_LOG_SCHEMA, {"mode": "PERMISSIVE"})
    return lines.select(*[c for c in lines.columns if c != line_col], parsed.alias("e"),
                        F.col(line_col).alias("_raw")).select(
        *[c for c in lines.columns if c != line_col], "e.*",
        F.when(F.col("e").isNull() | F.col("e.message").isNull(), F.col("_raw")).alias("_corrupt"))


def merged_fields(entries: DataFrame, extra_col: str = "extra") -> DataFrame:
    """Logger fields overridden by per-call fields (later keys win)."""
    fields, extra = F.col("fields"), F.col(extra_col)
    own = F.transform_values(fields, lambda k, v: F.when(F.map_contains_key(extra, k), extra[k]).otherwise(v))
    new = F.map_filter(extra, lambda k, _: ~F.map_contains_key(fields, k))
    return entries.select("*", F.map_concat(own, new).alias("merged_fields"))


# fixed values: how the service's logger words its records
DATABASE_OPERATION = "Database operation: %s"
SLOW_DATABASE_OPERATION = "Slow database operation detected"
BUSINESS_EVENT = "Business event: %s"
PERFORMANCE = "Performance: %s"
SLOW_DATABASE_MS = 100


def service_records(acc: DataFrame) -> DataFrame:
    """The records that the service logs while it handles requests, one row
    each, with trace, user and string fields: the span of every request, the
    database insert of every second one (a warning when it was slow) and a
    business event for every fifth.  A fixture view of the access rows."""
    text = lambda c: F.col(c).cast("string")
    insert_ms = F.col("duration_ms") % 200
    operation = F.concat_ws(" ", "http_method", "http_path")
    event = F.when(F.col("id") % 10 == 0, "alert_raised").otherwise("log_ingested")

    def record(when, level, message, **fields):
        pairs = [x for k, v in fields.items() for x in (F.lit(k), v)]
        return F.when(when, F.struct(level.alias("level"), message.alias("message"), F.create_map(*pairs).alias("fields")))

    records = F.array(
        record(F.lit(True), F.lit("INFO"), F.format_string(PERFORMANCE, operation), operation=operation,
               duration_ms=text("duration_ms"),
               status=F.when(F.col("http_status_code") >= 400, "error").otherwise("success")),
        record(F.col("id") % 2 == 0, F.when(insert_ms > SLOW_DATABASE_MS, "WARN").otherwise("DEBUG"),
               F.when(insert_ms > SLOW_DATABASE_MS, SLOW_DATABASE_OPERATION).otherwise(
                   F.format_string(DATABASE_OPERATION, F.lit("INSERT"))),
               operation=F.lit("INSERT"), table=F.lit("logs"), duration_ms=insert_ms.cast("string")),
        record(F.col("id") % 5 == 0, F.lit("INFO"), F.format_string(BUSINESS_EVENT, event), business_event=event,
               entity_id=F.concat(F.lit("log-"), text("id"))))
    return acc.select(
        "id", F.date_format("log_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.lit(SERVICE).alias("service"),
        F.lit("worker").alias("component"), F.concat(F.lit("trace-"), text("id")).alias("trace_id"),
        F.concat(F.lit("req-"), text("id")).alias("request_id"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("user-"), (F.col("id") % 7).cast("string"))).alias("user_id"),
        F.explode(F.filter(records, lambda r: r.isNotNull())).alias("r")).select("*", "r.*").drop("r")


def render_record_json(records: DataFrame) -> DataFrame:
    """One JSON line per record; absent trace, request or user are left out."""
    names = ("timestamp", "level", "message", "service", "component", "trace_id", "request_id", "user_id", "fields")
    return records.select(F.to_json(F.struct(*names)).alias("line"))


def with_tracebacks(records: DataFrame) -> DataFrame:
    """Records whose warnings carry a traceback, one line of which looks
    almost like a header.  A fixture view."""
    lines = F.concat(F.lit("Traceback (most recent call last):\n  File \"store.go\", line 48, in StoreLog\n\n[retry] WARN [store]\n"
                           "store.TimeoutError: insert "), F.col("request_id"), F.lit(" took too long"))
    return records.withColumn("traceback", F.when(F.col("level") == "WARN", lines))


def render_record_text(records: DataFrame) -> DataFrame:
    """One text line per record, tags only where there is something to tag,
    and the lines of its traceback behind, if it has one."""
    ts = F.regexp_replace(F.regexp_replace("timestamp", "T", " "), "Z$", "")
    tag = lambda name, c: F.coalesce(F.concat(F.lit(f" [{name}="), F.col(c), F.lit("]")), F.lit(""))
    return records.select(F.concat(
        F.lit("["), ts, F.lit("] "), "level", F.lit(" ["), "service", F.lit("/"), "component", F.lit("] store.go:48 StoreLog - "),
        "message", tag("trace", "trace_id"), tag("request", "request_id"), tag("user", "user_id"),
        F.lit(" fields="), F.to_json("fields"), _behind(records)).alias("line"))


def _behind(records: DataFrame):
    """What stands on the lines after a record's header line."""
    if "traceback" not in records.columns:
        return F.lit("")
    return F.coalesce(F.concat(F.lit("\n"), F.col("traceback")), F.lit(""))


HEADER_LINE = r"^\[[^\]]*\] \S+ \[[^/\]]*/[^\]]*\] \S*:\d+ "
EXCEPTION_LINE = r"^([A-Za-z_][\w.]*)(?:: (.*))?$"


def text_records(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, line, more): the records of text-layout files.  ``line`` is
    a record's header line and ``more`` the lines that follow it up to the next
    header, such as a traceback's.

    Files stay split.  A line's place is (file, split, line in it); inside a
    split, a window of one split's rows at most, the headers are counted; lines
    before a split's first header belong to the last header of the splits
    before, which a frame of one row per split tells.  Lines before a file's
    first header have none; each is a record of its own.
    """
    lines = spark.read.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    inside = Window.partitionBy("file_path", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("nr", F.sum(F.col("line").rlike(HEADER_LINE).cast("int")).over(inside))
    splits = lines.groupBy("file_path", "split").agg(F.max("nr").alias("headers"))
    before = Window.partitionBy("file_path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("headers") > 0, F.struct(F.col("split").alias("split"), F.col("headers").alias("nr"))), True).over(before)
    splits = splits.select("file_path", "split", last.alias("last"))
    owner = (F.when(F.col("nr") > 0, F.struct("split", "nr", F.lit(None).cast("bigint").alias("at")))
             .when(F.col("last").isNotNull(), F.struct(F.col("last.split").alias("split"), F.col("last.nr").alias("nr"),
                                                       F.lit(None).cast("bigint").alias("at")))
             .otherwise(F.struct("split", F.lit(0).cast("bigint").alias("nr"), "at")))
    owned = lines.join(splits, ["file_path", "split"]).select("file_path", owner.alias("record"), F.struct("split", "at", "line").alias("piece"))
    together = owned.groupBy("file_path", "record").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    own = F.transform("pieces", lambda p: p["line"])
    return together.select("file_path", F.get(own, 0).alias("line"), F.slice(own, 2, F.greatest(F.size(own) - 1, F.lit(1))).alias("more"))


def read_text_log(spark: SparkSession, path: str) -> DataFrame:
    """Service-log files in the text layout, a record's further lines with it:
    ``traceback`` (null without) and, from its last line, the exception's type
    and message."""
    records = text_records(spark, path).select(
        "line", F.when(F.size("more") > 0, F.array_join("more", "\n")).alias("traceback"),
        F.get(F.filter("more", lambda x: F.trim(x) != ""), F.size(F.filter("more", lambda x: F.trim(x) != "")) - 1).alias("last"))
    told = lambda i: F.nullif(F.regexp_extract("last", EXCEPTION_LINE, i), F.lit(""))
    return parse_text(records.select("*", told(1).alias("exception_type"), told(2).alias("exception_message")).drop("last"))


def read_json_log(spark: SparkSession, path: str) -> DataFrame:
    """Service-log files with one JSON object per line."""
    return parse_json(spark.read.text(path).withColumnRenamed("value", "line"))


def _field(name: str):
    return F.element_at("fields", name)


def span_durations(entries: DataFrame) -> DataFrame:
    """Per operation and outcome of the performance records: count, mean and
    longest duration, and the exact p50, p95 and p99 (element int(q * n)) of
    those that state one.  A busy operation is spread over tasks."""
    ms = _field("duration_ms").try_cast("double")
    spans = (entries.filter(F.col("message").startswith(PERFORMANCE % ""))
             .select(_field("operation").alias("operation"), _field("status").alias("status"), ms.alias("ms")))
    n = F.col("n")
    counts = spans.groupBy("operation", "status").agg(F.count(F.lit(1)).alias("count"))
    stats = Q.grouped_order_statistics(spans, ["operation", "status"], "ms", {
        "p50": F.floor(n / 2), "p95": Q.nearest_rank(n, 0.95), "p99": Q.nearest_rank(n, 0.99)})
    same = F.col("c.operation").eqNullSafe(F.col("s.operation")) & F.col("c.status").eqNullSafe(F.col("s.status"))
    return counts.alias("c").join(stats.alias("s"), same, "left").select(
        "c.operation", "c.status", "c.count", F.col("s.average").alias("avg_duration_ms"),
        F.col("s.max").alias("max_duration_ms"), F.col("s.p50").alias("p50_duration_ms"),
        F.col("s.p95").alias("p95_duration_ms"), F.col("s.p99").alias("p99_duration_ms"))


def database_operations(entries: DataFrame) -> DataFrame:
    """Per operation and table of the database records: count, slow ones, mean
    duration."""
    ms = _field("duration_ms").try_cast("double")
    return entries.filter(_field("table").isNotNull()).groupBy(
        _field("operation").alias("operation"), _field("table").alias("table_name")).agg(
        F.count(F.lit(1)).alias("count"), F.count(F.when(ms > SLOW_DATABASE_MS, 1)).alias("slow"),
        F.avg(ms).alias("avg_duration_ms"))


def business_events(entries: DataFrame) -> DataFrame:
    """Counts of the business-event records and of the entities they name."""
    event = _field("business_event")
    return entries.filter(event.isNotNull()).groupBy(event.alias("business_event")).agg(
        F.count(F.lit(1)).alias("count"), F.countDistinct(_field("entity_id")).alias("entities"))

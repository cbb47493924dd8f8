"""Ingest: validate raw JSON payloads into log rows, quarantine the rest.

One pass over the payload column decides, per row, the route (structured,
legacy) or the rejection reason, with the same precedence as the original
HTTP handler:

1. not a JSON object                       -> ``Invalid JSON format``
2. key ``message`` present                 -> structured entry; a wrongly typed
   field or a non-RFC3339 timestamp          -> ``Invalid structured log entry``
3. else key ``log`` present                -> legacy entry (level info,
   source legacy_api); a non-string log makes the handler fail -> ``Internal server error``
4. else                                    -> ``Missing required fields ...``

then validation (empty message, level outside the ten accepted spellings)
and the table's column limits.  Key presence is case-sensitive and a JSON
null counts as present.  Types are read from the VARIANT form of the
payload, so no Python code runs per row.

The fields of a structured entry are matched without regard to case, as the
handler's decoder does: of one exact name given twice the last stands, the
names are then taken in byte order (so ``level`` after ``Level`` after
``LEVEL``), a null changes nothing, the last value stays, and a wrong type
under any of the names rejects the entry.  Only payloads with such names take
that longer way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import levels as L
from ..sources.scans import ts_lit

# fixed values: rejection messages of the ingest handler
INVALID_JSON = "Invalid JSON format"
INVALID_STRUCTURED = "Invalid structured log entry"
MISSING_FIELDS = "Missing required fields: either 'message' or 'log' field required"
EMPTY_MESSAGE = "message cannot be empty"
INVALID_LEVEL = "invalid log level"
STORE_FAILED = "Failed to store log entry"
HANDLER_FAILED = "Internal server error"

RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
DEFAULT_INGEST_TS = "2024-02-01 00:00:00"


FIELDS = ("id", "timestamp", "level", "message", "source")
_STRING = ("STRING", "VOID")
_INTEGER = ("VOID", "BIGINT", "INT", "SMALLINT", "TINYINT")


def _vtype(field: str) -> Column:
    return F.expr(f"schema_of_variant(variant_get(__v, '$.{field}', 'variant'))")


def _vstr(field: str) -> Column:
    return F.expr(f"try_variant_get(__v, '$.{field}', 'string')")


def _typed(field: str, types) -> Column:
    t = _vtype(field)
    return t.isNull() | t.isin(*types)


# a field's name in any case but its own, among names that stand on lines of their own
_OTHER_CASE = (r"(?m)^(?!(?:{0})$)(?i:{0})$").format("|".join(FIELDS))


def _odd(keys: Column) -> Column:
    """Whether a field's name stands in another case, or any name twice."""
    other = F.array_join(keys, "\n").rlike(_OTHER_CASE)
    return F.coalesce(other | (F.size(keys) != F.size(F.array_distinct(keys))), F.lit(False))


def _resolved(payload: str) -> Column:
    """The payload of odd names as a VARIANT with the plain ones: for each
    field a wrongly typed value, if there is one under any of its names, else
    the last that is not null."""
    names = """array_sort(filter(transform(__keys, (k, i) -> struct(k AS name, i AS nr)),
        e -> NOT array_contains(slice(__keys, e.nr + 2, size(__keys)), e.name)))"""
    values = f"map_values(from_json(`{payload}`, 'map<string,variant>'))"

    def value(field: str, good: str) -> str:
        mine = f"transform(filter(__names, e -> lower(e.name) = '{field}'), e -> __values[e.nr])"
        bad = f"filter({mine}, v -> NOT coalesce({good}, false))"
        told = f"filter({mine}, v -> schema_of_variant(v) <> 'VOID')"
        return f"coalesce(get({bad}, 0), get({told}, size({told}) - 1)) AS {field}"

    kinds = lambda types: "schema_of_variant(v) IN (" + ", ".join(f"'{t}'" for t in types) + ")"
    time = "try_variant_get(v, '$', 'string')"
    rule = RFC3339.replace("\\", "\\\\")
    time_ok = (f"schema_of_variant(v) = 'VOID' OR (schema_of_variant(v) = 'STRING' AND {time} RLIKE '{rule}' "
               f"AND try_to_timestamp({time}) IS NOT NULL)")
    fields = [value("id", kinds(_INTEGER)), value("timestamp", time_ok), *[value(f, kinds(_STRING)) for f in ("level", "message", "source")],
              "get(transform(filter(__names, e -> e.name = 'log'), e -> __values[e.nr]), 0) AS log"]
    built = f"to_variant_object(struct({', '.join(fields)}))"
    # __names and __values are bound by one-element arrays, so they are made once
    return F.expr(f"get(transform(array(struct({names} AS n, {values} AS v)), x -> "
                  f"{built.replace('__names', 'x.n').replace('__values', 'x.v')}), 0)")


def route_payloads(raw: DataFrame, payload_col: str = "payload", ingest_ts=None) -> DataFrame:
    """Add ``route`` (structured/legacy/null), ``reason`` (null when accepted)
    and the typed log columns to every raw row."""
    p = F.col(payload_col)
    ts_now = ts_lit(ingest_ts or DEFAULT_INGEST_TS) if not isinstance(ingest_ts, Column) else ingest_ts
    keys = F.json_object_keys(p)
    df = raw.withColumn("__keys", keys).withColumn("__odd", _odd(F.col("__keys")))
    df = df.withColumn("__v", F.when(F.col("__odd"), _resolved(payload_col)).otherwise(F.try_parse_json(p)))
    has = lambda k: F.coalesce(F.array_contains(F.col("__keys"), k), F.lit(False))
    is_obj = F.col("__keys").isNotNull()
    is_null_doc = F.coalesce(F.expr("schema_of_variant(__v)") == "VOID", F.lit(False))  # JSON null: empty object

    ts_raw = _vstr("timestamp")
    ts_type = _vtype("timestamp")
    ts_given = ts_type.isNotNull() & (ts_type != "VOID")
    ts_parsed = F.try_to_timestamp(ts_raw).cast("timestamp_ntz")
    ts_ok = (~ts_given) | ((ts_type == "STRING") & ts_raw.rlike(RFC3339) & ts_parsed.isNotNull())
    types_ok = (_typed("message", _STRING) & _typed("level", _STRING) & _typed("source", _STRING)
                & _typed("id", _INTEGER) & ts_ok)

    msg_s = F.coalesce(_vstr("message"), F.lit(""))
    lvl_s = F.coalesce(_vstr("level"), F.lit(""))
    src_s = F.coalesce(F.nullif(F.coalesce(_vstr("source"), F.lit("")), F.lit("")), F.lit("unknown"))
    log_s = _vstr("log")

    structured = is_obj & has("message")
    legacy = (is_obj & ~has("message") & has("log"))
    reason = (
        F.when(~is_obj & ~is_null_doc, F.lit(INVALID_JSON))
         .when(structured & ~types_ok, F.lit(INVALID_STRUCTURED))
         .when(structured & (msg_s == ""), F.lit(EMPTY_MESSAGE))
         .when(structured & ~L.is_valid_ingest_level(lvl_s), F.lit(INVALID_LEVEL))
         .when(structured & (F.length(src_s) > 100), F.lit(STORE_FAILED))
         .when(legacy & (_vtype("log") != "STRING"), F.lit(HANDLER_FAILED))
         .when(legacy & (F.coalesce(log_s, F.lit("")) == ""), F.lit(EMPTY_MESSAGE))
         .when(~structured & ~legacy, F.lit(MISSING_FIELDS))
    )
    route = F.when(reason.isNull(), F.when(structured, F.lit("structured")).otherwise(F.lit("legacy")))
    out = df.select(
        "*",
        route.alias("route"),
        reason.alias("reason"),
        F.when(structured, msg_s).otherwise(log_s).alias("message"),
        F.when(structured, lvl_s).otherwise(F.lit("info")).alias("level"),
        F.when(structured, src_s).otherwise(F.lit("legacy_api")).alias("source"),
        F.when(structured & ts_given, ts_parsed).otherwise(ts_now).alias("log_ts"),
    )
    return out.drop("__v", "__keys", "__odd")


def accepted(routed: DataFrame) -> DataFrame:
    return routed.filter(F.col("reason").isNull()).select("id", "log_ts", "level", "message", "source", "route")


def rejects(routed: DataFrame, payload_col: str = "payload") -> DataFrame:
    return routed.filter(F.col("reason").isNotNull()).select("id", F.col(payload_col).alias("payload"), "reason")


def route_counts(routed: DataFrame) -> DataFrame:
    return (routed.groupBy(F.coalesce(F.col("reason"), F.lit("accepted")).alias("outcome"))
            .agg(F.count(F.lit(1)).alias("count")))


def text_lines(docs: DataFrame, text_col: str = "text", key_col: str = "doc_id", ingest_ts=None) -> DataFrame:
    """Raw text ingest: every non-empty line of every text becomes a log
    (level sniffed from the line, source ``parse_logs_script``).  Empty lines
    are dropped because the ingest endpoint rejects empty messages."""
    ts_now = ts_lit(ingest_ts or DEFAULT_INGEST_TS)
    lines = docs.select(key_col, F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"))
                        .alias("line_no", "message"))
    return (lines.filter(F.col("message") != "")
            .select(key_col, F.col("line_no").cast("bigint").alias("line_no"),
                    L.sniff_level(F.col("message")).alias("level"), "message",
                    F.lit("parse_logs_script").alias("source"), ts_now.alias("log_ts")))

"""Statistical ("ML") anomaly detection.

Design notes for scale
----------------------
* Features are multi-level aggregates (per signature / hour / minute bucket,
  then per group), never a collect of rows.
* Global means and standard deviations are one-row aggregates joined back
  with ``crossJoin(broadcast(...))`` - the broadcast side is one row.
* Per-source error gaps would serialise a hot source into one window
  partition.  :func:`error_gaps` therefore orders rows inside
  (source, time bucket) partitions and stitches bucket edges with a second,
  tiny window over one row per bucket.
* Merging similar anomalies is an equivalence-class ``groupBy``.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig, checkpoint_dir
from ..functions import levels as L
from ..schema import LEVELS
from ..sources.normalize import enrich
from ..sources.scans import newest_ts, ts_lit
from .buckets import ROWS_PER_BUCKET, bucketed

FEATURES = ("error_rate", "message_entropy", "temporal_variance", "source_diversity",
            "total_volume", "volume_variance") + tuple(f"level_{lv}_ratio" for lv in LEVELS)


ML_COLUMNS = ("signature", "is_narrow_error")


def _e(df: DataFrame, cfg: EngineConfig = DEFAULT, cols=ML_COLUMNS) -> DataFrame:
    return enrich(df, cfg, cols)


def features_by(df: DataFrame, keys=(), cfg: EngineConfig = DEFAULT) -> DataFrame:
    """The eleven features per group of ``keys`` (one row when keys is empty).

    One scan and two small shuffles: rows are counted once per signature, hour
    of day, minute of day, level and source (grouping sets; each map task
    sends one row per value it has seen), and every feature is a conditional
    aggregate of these counts.
    """
    keys = list(keys)
    e = _e(df, cfg).select(*keys, "signature", F.date_format("log_ts", "HH:mm").alias("minute"), "level", "source")
    e = e.withColumn("hour_of_day", F.substring("minute", 1, 2))
    kinds = ("signature", "hour_of_day", "minute", "level", "source")
    counts = e.groupingSets([[*keys, k] for k in kinds], *keys, *kinds).agg(
        F.count(F.lit(1)).alias("c"), *[F.grouping(k).alias(f"_{k}") for k in kinds])
    of = lambda k, more=None: F.when((F.col(f"_{k}") == 0) if more is None else (F.col(f"_{k}") == 0) & more, F.col("c"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    signed = of("signature")
    # rows without a time are a null hour and minute, left out of the variances
    hours, minutes = (of(k, F.col(k).isNotNull()) for k in ("hour_of_day", "minute"))
    # entropy = log2(N) - sum(c * log2 c) / N over signature counts c
    j = counts.groupBy(*keys).agg(
        F.sum(of("level")).alias("n"), total(of("level", L.is_narrow_error(F.col("level")))).alias("n_err"),
        F.count(of("source", F.col("source").isNotNull())).alias("n_src"),
        *[total(of("level", F.col("level") == x)).alias(f"n_{x}") for x in LEVELS],
        (F.log2(F.sum(signed)) - F.sum(signed * F.log2("c")) / F.sum(signed)).alias("message_entropy"),
        F.when(F.count(hours) > 1, F.var_pop(hours)).otherwise(F.lit(0.0)).alias("tv"),
        F.when(F.count(minutes) > 1, F.var_pop(minutes)).otherwise(F.lit(0.0)).alias("vv")).filter(F.col("n") > 0)
    n = F.col("n")
    return j.select(
        *keys,
        (F.col("n_err") / n).alias("error_rate"),
        F.greatest(F.coalesce(F.col("message_entropy"), F.lit(0.0)), F.lit(0.0)).alias("message_entropy"),
        F.when(n < 2, F.lit(0.0)).otherwise(F.col("tv")).alias("temporal_variance"),
        (F.col("n_src") / n).alias("source_diversity"),
        n.cast("double").alias("total_volume"), F.col("vv").alias("volume_variance"),
        *[(F.col(f"n_{x}") / n).alias(f"level_{x}_ratio") for x in LEVELS])


def ml_features(df: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    return features_by(df, (), cfg)


def message_entropy(df: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """The entropy feature alone: one count per signature."""
    counts = enrich(df, cfg, ("signature",)).groupBy("signature").agg(F.count(F.lit(1)).alias("c"))
    entropy = F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c")
    return (counts.agg(F.sum("c").alias("n"), entropy.alias("h")).filter(F.col("n") > 0)
            .select(F.greatest(F.col("h"), F.lit(0.0)).alias("message_entropy")))


def _variance_alone(df: DataFrame, fmt: str, name: str) -> DataFrame:
    counts = df.groupBy(F.date_format("log_ts", fmt).alias("b")).agg(F.count(F.lit(1)).alias("c"))
    timed = F.when(F.col("b").isNotNull(), F.col("c"))
    return (counts.agg(F.sum("c").alias("n"), F.count(timed).alias("k"), F.var_pop(timed).alias("v"))
            .filter(F.col("n") > 0).select(F.when(F.col("k") > 1, F.col("v")).otherwise(F.lit(0.0)).alias(name)))


def temporal_variance(df: DataFrame) -> DataFrame:
    """The variance of the counts per hour of day alone."""
    return _variance_alone(df, "HH", "temporal_variance")


def volume_variance(df: DataFrame) -> DataFrame:
    """The variance of the counts per minute of day alone."""
    return _variance_alone(df, "HH:mm", "volume_variance")


def _stack(feat: DataFrame, keys=()) -> DataFrame:
    expr = "stack({}, {}) as (feature, value)".format(
        len(FEATURES), ", ".join(f"'{f}', cast({f} as double)" for f in FEATURES))
    return feat.selectExpr(*keys, expr)


CURRENT = "current"


def _windowed_features(df: DataFrame, days: int, as_of, cfg: EngineConfig) -> DataFrame:
    """Features per history day in [as_of - 1 day - days, as_of - 1 day] and
    for the current window (as_of - 1 day, as_of], in one pass
    (group ``feature_day`` = the day, or 'current')."""
    cut = as_of - _dt.timedelta(days=1)
    start = cut - _dt.timedelta(days=days)
    rows = df.filter(F.col("log_ts").between(ts_lit(start), ts_lit(as_of)))
    g = F.when(F.col("log_ts") > ts_lit(cut), F.lit(CURRENT)).otherwise(F.date_format("log_ts", "yyyy-MM-dd"))
    return features_by(rows.withColumn("feature_day", g), ("feature_day",), cfg)


def _baseline_from(daily: DataFrame) -> DataFrame:
    hist = daily.filter(F.col("feature_day") != CURRENT)
    return (_stack(hist, ("feature_day",)).groupBy("feature")
            .agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
                 F.count(F.lit(1)).alias("n_days")))


def baseline_features(df: DataFrame, days: int = 7, as_of=None, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Per feature: mean and population std of the daily feature vectors of
    the history window [as_of - 1 day - days, as_of - 1 day]."""
    as_of = newest_ts(df) if as_of is None else as_of
    cut = as_of - _dt.timedelta(days=1)
    return _baseline_from(_windowed_features(df.filter(F.col("log_ts") <= ts_lit(cut)), days, as_of, cfg))


def statistical_anomalies(df: DataFrame, days: int = 7, as_of=None, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Features of the last 24 h before ``as_of`` whose z-score against the
    baseline exceeds 2.5 in absolute value (high above 3)."""
    as_of = newest_ts(df) if as_of is None else as_of
    daily = _windowed_features(df, days, as_of, cfg)
    base = _baseline_from(daily)                                      # at most 11 rows
    cur_f = _stack(daily.filter(F.col("feature_day") == CURRENT), ("feature_day",)).drop("feature_day")
    j = cur_f.join(F.broadcast(base), "feature")
    z = L.z_score(F.col("value"), F.col("mean"), F.col("std"))
    return (j.select("feature", "value", F.col("mean").alias("expected"), z.alias("z_score"))
            .filter(F.abs(F.col("z_score")) > 2.5)
            .select("*", L.confidence(F.col("z_score")).alias("confidence"),
                    F.when(F.abs(F.col("z_score")) > 3, "high").otherwise("medium").alias("severity"),
                    F.format_string("Statistical anomaly in %s: %.3f (expected: %.3f)",
                                    F.col("feature"), F.col("value"), F.col("expected")).alias("description")))


def _with_pop_stats(counts: DataFrame, col: str) -> DataFrame:
    stats = counts.agg(F.count(F.lit(1)).alias("n_groups"), F.avg(col).alias("mean"),
                       F.stddev_pop(col).alias("std"))
    return counts.crossJoin(F.broadcast(stats))                        # one-row broadcast


def _window_signature_counts(df: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Rows and error/fatal rows per (tumbling window, message signature).

    The pattern and the temporal detectors both derive from this frame.
    Passing it in precomputed (``counts=``) lets several detectors share one
    scan; :func:`ml_anomalies` does that with a checkpointed copy.
    """
    if "c_err" in df.columns:                     # already the counts frame
        return df
    e = _e(df, cfg)
    win = F.window("log_ts", f"{cfg.window_minutes} minutes").start
    return (e.groupBy(win.alias("window_start"), "signature")
            .agg(F.count(F.lit(1)).alias("c"), F.count(F.when(F.col("is_narrow_error"), 1)).alias("c_err")))


def pattern_anomalies(df: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Message signatures with population z > 2 (frequent) or z < -2 and a
    single occurrence (rare); nothing when all counts are equal."""
    counts = (_window_signature_counts(df, cfg).groupBy(F.col("signature").alias("pattern"))
              .agg(F.sum("c").alias("count")))
    s = _with_pop_stats(counts, "count").filter(F.col("std") > 0)
    z = (F.col("count") - F.col("mean")) / F.col("std")
    s = s.select("pattern", "count", F.col("mean").alias("expected"), z.alias("z_score"))
    freq = s.filter(F.col("z_score") > 2.0).select(
        F.lit("frequent_pattern_anomaly").alias("type"), "pattern", "count", "expected", "z_score",
        F.least(F.col("z_score") / 3.0, F.lit(1.0)).alias("confidence"), F.lit("medium").alias("severity"),
        F.format_string("Unusually frequent pattern: '%s' appeared %d times", F.col("pattern"), F.col("count"))
         .alias("description"))
    rare = s.filter((F.col("z_score") < -2.0) & (F.col("count") == 1)).select(
        F.lit("rare_pattern_anomaly").alias("type"), "pattern", "count",
        F.lit(None).cast("double").alias("expected"), "z_score",
        F.lit(0.6).alias("confidence"), F.lit("low").alias("severity"),
        F.format_string("Rare pattern detected: '%s'", F.col("pattern")).alias("description"))
    return freq.unionByName(rare)


def volume_by_window(df: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Non-empty tumbling windows of ``window_minutes``: volume and error rate."""
    timed = F.col("window_start").isNotNull()
    return (_window_signature_counts(df, cfg).groupBy("window_start")
            .agg(F.sum(F.when(timed, F.col("c"))).alias("volume"),
                 F.sum(F.when(timed, F.col("c_err"))).alias("error_count"))
            .filter(F.col("volume").isNotNull())          # drops the bucket of rows without a timestamp
            .select("window_start", "volume", "error_count",
                    (F.col("error_count") / F.col("volume")).alias("error_rate")))


def temporal_volume_anomalies(df: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Windows whose volume has population |z| > 2 (needs at least 3 windows)."""
    s = _with_pop_stats(volume_by_window(df, cfg), "volume").filter((F.col("n_groups") >= 3) & (F.col("std") > 0))
    z = (F.col("volume") - F.col("mean")) / F.col("std")
    s = s.select("window_start", "volume", "mean", z.alias("z_score")).filter(F.abs(F.col("z_score")) > 2.0)
    kind = F.when(F.col("z_score") > 0, "volume_spike").otherwise("volume_drop")
    return s.select(
        F.concat(F.lit("temporal_"), kind).alias("type"), "window_start", "volume",
        F.col("mean").alias("expected"), "z_score", L.confidence(F.col("z_score")).alias("confidence"),
        F.when(F.abs(F.col("z_score")) > 3, "high").otherwise("medium").alias("severity"),
        F.format_string("Temporal %s: %d logs in window (expected: %.1f)", kind, F.col("volume"), F.col("mean"))
         .alias("description"))


def temporal_error_spikes(df: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Windows whose error rate has population z > 2 (needs at least 3 windows)."""
    s = _with_pop_stats(volume_by_window(df, cfg), "error_rate").filter((F.col("n_groups") >= 3) & (F.col("std") > 0))
    z = (F.col("error_rate") - F.col("mean")) / F.col("std")
    s = s.select("window_start", "error_rate", "mean", z.alias("z_score")).filter(F.col("z_score") > 2.0)
    return s.select(
        F.lit("temporal_error_spike").alias("type"), "window_start", "error_rate",
        F.col("mean").alias("expected"), "z_score",
        F.least(F.col("z_score") / 3.0, F.lit(1.0)).alias("confidence"), F.lit("high").alias("severity"),
        F.format_string("Error rate spike: %.1f%% in window (expected: %.1f%%)",
                        F.col("error_rate") * 100, F.col("mean") * 100).alias("description"))


def error_gaps(df: DataFrame, cfg: EngineConfig = DEFAULT, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Seconds since the previous error/fatal of the same source (ordered by
    time, id).  The first error of a source has no gap (null).

    A window partitioned by source would put a hot source into one task.
    ``lag`` runs inside pieces of the source's errors instead (:mod:`.buckets`); the first
    row of a bucket takes the last timestamp of the source's previous bucket,
    from a frame with one row per (source, bucket).
    """
    e = _e(df, cfg, ("is_narrow_error",)).filter(F.col("is_narrow_error") & F.col("log_ts").isNotNull())
    err = bucketed(e.select("source", "id", "log_ts"), ["source"], ["log_ts", "id"], rows_per_bucket)
    inner = Window.partitionBy("_key", "_bucket").orderBy("log_ts", "id")
    g = err.withColumn("prev_ts", F.lag("log_ts").over(inner))
    edges = (err.groupBy("_key", "_bucket").agg(F.max("log_ts").alias("last_ts"))
             .withColumn("prev_last", F.lag("last_ts").over(Window.partitionBy("_key").orderBy("_bucket")))
             .select("_key", "_bucket", "prev_last"))
    j = g.join(edges, ["_key", "_bucket"])
    prev = F.coalesce(F.col("prev_ts"), F.col("prev_last"))
    gap = F.expr("timestampdiff(MICROSECOND, prev, log_ts)") / 1e6
    return j.select("source", "id", "log_ts", prev.alias("prev")).select(
        "source", "id", "log_ts", gap.alias("gap_seconds"))


def error_time_clustering(df: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Per source with >= 5 logs and >= 1 error: clustering score
    1 - (pop std / mean of error gaps) / 2, floored at 0; 1 when the mean gap
    is 0; 0 with fewer than two errors."""
    e = _e(df, cfg, ("is_narrow_error",))
    per_src = (e.groupBy("source").agg(F.count(F.lit(1)).alias("total_logs"),
                                      F.count(F.when(F.col("is_narrow_error"), 1)).alias("error_count"))
               .filter((F.col("total_logs") >= cfg.min_source_logs) & (F.col("error_count") > 0)))
    gaps = (error_gaps(e, cfg).filter(F.col("gap_seconds").isNotNull()).groupBy("source")
            .agg(F.avg("gap_seconds").alias("mean_gap"), F.stddev_pop("gap_seconds").alias("std_gap")))
    j = per_src.join(gaps, "source", "left")
    score = (F.when(F.col("error_count") < 2, F.lit(0.0))
              .when(F.col("mean_gap") == 0, F.lit(1.0))
              .otherwise(F.greatest(F.lit(0.0), 1.0 - (F.col("std_gap") / F.col("mean_gap")) / 2.0)))
    return j.select("source", "total_logs", "error_count", score.alias("clustering_score"))


def clustering_anomalies(df: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    s = error_time_clustering(df, cfg).filter(F.col("clustering_score") > cfg.clustering_threshold)
    return s.select(
        F.lit("error_time_clustering").alias("type"), "source", F.col("error_count").alias("count"),
        F.col("clustering_score").alias("value"), F.col("clustering_score").alias("confidence"),
        F.lit("high").alias("severity"),
        F.format_string("Error clustering detected in %s: %d errors clustered in time",
                        F.col("source"), F.col("error_count")).alias("description"))


ANOMALY_COLUMNS = (("detector", "string"), ("ordinal", "int"), ("type", "string"), ("source", "string"),
                   ("pattern", "string"), ("feature", "string"), ("window_start", "timestamp_ntz"),
                   ("count", "bigint"), ("value", "double"), ("expected", "double"), ("z_score", "double"),
                   ("confidence", "double"), ("severity", "string"), ("description", "string"))


def _wide(df: DataFrame, detector: str, ordinal: int, **renames) -> DataFrame:
    cols = set(df.columns)
    out = []
    for name, typ in ANOMALY_COLUMNS:
        if name == "detector":
            out.append(F.lit(detector).alias(name))
        elif name == "ordinal":
            out.append(F.lit(ordinal).alias(name))
        else:
            src = renames.get(name, name)
            c = F.col(src) if src in cols else F.lit(None)
            out.append(c.cast(typ).alias(name))
    return df.select(*out)


def ml_anomalies(df: DataFrame, days: int = 7, as_of=None, with_baseline: bool = True,
                 cfg: EngineConfig = DEFAULT) -> DataFrame:
    """All detectors in the wide anomaly layout (before merging)."""
    e = _e(df, cfg)
    parts = []
    if with_baseline:
        st = statistical_anomalies(df, days, as_of, cfg).select("*", F.lit("statistical_anomaly").alias("type"))
        parts.append(_wide(st, "statistical", 1))
    # one (window, signature) aggregate feeds three detectors; each prunes it
    # differently, so it is materialized once instead of rescanning the input
    checkpoint_dir(df.sparkSession)
    wsc = _window_signature_counts(e, cfg).checkpoint(eager=True)
    parts.append(_wide(pattern_anomalies(wsc, cfg), "pattern", 2))
    parts.append(_wide(temporal_volume_anomalies(wsc, cfg), "temporal", 3, value="volume"))
    parts.append(_wide(temporal_error_spikes(wsc, cfg), "temporal", 4, value="error_rate"))
    parts.append(_wide(clustering_anomalies(e, cfg), "clustering", 5))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def merge_similar(anoms: DataFrame) -> DataFrame:
    """Merge anomalies of the same type that share a source (or, lacking
    sources, a pattern).  Within a type this relation is an equivalence, so
    pairwise merging equals one ``groupBy``.  The representative is the most
    confident member; counts add up, confidence is the maximum."""
    src_ok = F.col("source").isNotNull() & (F.col("source") != "")
    pat_ok = F.col("pattern").isNotNull() & (F.col("pattern") != "")
    uniq = F.concat_ws("|", F.col("detector"), F.col("ordinal").cast("string"), F.coalesce(F.col("feature"), F.lit("")),
                       F.coalesce(F.col("window_start").cast("string"), F.lit("")), F.coalesce(F.col("pattern"), F.lit("")))
    key = (F.when(src_ok, F.concat(F.lit("s:"), F.col("source")))
            .when(pat_ok, F.concat(F.lit("p:"), F.col("pattern")))
            .otherwise(F.concat(F.lit("u:"), uniq)))
    cols = [c for c, _ in ANOMALY_COLUMNS]
    g = (anoms.withColumn("merge_key", key).groupBy("type", "merge_key")
         .agg(F.max_by(F.struct(*cols), F.struct(F.col("confidence"), -F.col("ordinal"))).alias("rep"),
              F.count(F.lit(1)).alias("n"),
              F.sum(F.coalesce(F.col("count"), F.lit(1))).alias("sum_count"),
              F.max("confidence").alias("max_conf")))
    merged = F.col("n") > 1
    sel = []
    for c in cols:
        if c == "count":
            sel.append(F.when(merged & F.col("rep.count").isNotNull(), F.col("sum_count"))
                        .otherwise(F.col("rep.count")).cast("bigint").alias("count"))
        elif c == "confidence":
            sel.append(F.col("max_conf").alias("confidence"))
        elif c == "description":
            sel.append(F.when(merged, F.concat(F.col("rep.description"), F.lit(" (merged from "),
                                               F.col("n").cast("string"), F.lit(" similar anomalies)")))
                        .otherwise(F.col("rep.description")).alias("description"))
        else:
            sel.append(F.col(f"rep.{c}").alias(c))
    sel.append(F.when(merged, F.col("n")).cast("bigint").alias("merged_count"))
    return g.select(*sel)


def merged_anomalies(df: DataFrame, days: int = 7, as_of=None, with_baseline: bool = True,
                     cfg: EngineConfig = DEFAULT) -> DataFrame:
    return merge_similar(ml_anomalies(df, days, as_of, with_baseline, cfg))


def ml_anomalies_confident(df: DataFrame, days: int = 7, as_of=None, cfg: EngineConfig = DEFAULT) -> DataFrame:
    return merged_anomalies(df, days, as_of, True, cfg).filter(F.col("confidence") >= cfg.ml_confidence_threshold)

"""Anomalies of many days, joined into episodes.

Every stored day is judged by its own windows; what is found on all days is
united, and detections of one type and source that follow each other within
``gap`` become one episode, as the detectors merge similar anomalies: counts
add up, the confidence is the highest, ``merged_count`` tells how many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import levels as L
from ..sources.normalize import enrich

GAP = "1 hour"
COLUMNS = ("type", "source", "started", "ended", "count", "confidence")


def _windows(df: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Volume, errors and their population statistics within the day, per window."""
    w = F.window("log_ts", f"{cfg.window_minutes} minutes")
    e = enrich(df.filter(F.col("log_ts").isNotNull()), cfg, ("is_narrow_error",))
    windows = (e.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("volume"), F.count(F.when(F.col("is_narrow_error"), 1)).alias("errors"))
               .select(F.col("w.start").alias("started"), F.col("w.end").alias("ended"), F.to_date("w.start").alias("day"),
                       "volume", "errors", (F.col("errors") / F.col("volume")).alias("rate")))
    days = windows.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.avg("volume").alias("volume_mean"), F.stddev_pop("volume").alias("volume_std"),
                                      F.avg("rate").alias("rate_mean"), F.stddev_pop("rate").alias("rate_std"))
    return windows.join(days, "day").filter(F.col("n") >= 3)


def daily_detections(df: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """COLUMNS of each day's volume spikes and drops, error spikes, and
    sources of which more than a fifth of at least six logs are errors."""
    w = _windows(df, cfg)
    volume_z = F.when(F.col("volume_std") > 0, (F.col("volume") - F.col("volume_mean")) / F.col("volume_std"))
    rate_z = F.when(F.col("rate_std") > 0, (F.col("rate") - F.col("rate_mean")) / F.col("rate_std"))
    scored = w.withColumns({"volume_z": volume_z, "rate_z": rate_z})
    volume = scored.filter(F.abs("volume_z") > 2.0).select(
        F.when(F.col("volume_z") > 0, "temporal_volume_spike").otherwise("temporal_volume_drop").alias("type"),
        F.lit(None).cast("string").alias("source"), "started", "ended", F.col("volume").alias("count"),
        L.confidence(F.col("volume_z")).alias("confidence"))
    errors = scored.filter(F.col("rate_z") > 2.0).select(
        F.lit("temporal_error_spike").alias("type"), F.lit(None).cast("string").alias("source"), "started", "ended",
        F.col("errors").alias("count"), L.confidence(F.col("rate_z")).alias("confidence"))
    e = enrich(df.filter(F.col("log_ts").isNotNull()), cfg, ("is_narrow_error",))
    share = F.col("errors") / F.col("n")
    sources = (e.groupBy("source", F.to_date("log_ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_narrow_error"), 1)).alias("errors"))
               .filter((F.col("n") > 5) & (share > 0.2))
               .select(F.lit("high_error_rate").alias("type"), "source", F.col("day").cast("timestamp_ntz").alias("started"),
                       F.date_add("day", 1).cast("timestamp_ntz").alias("ended"), F.col("errors").alias("count"), share.alias("confidence")))
    return volume.unionByName(errors).unionByName(sources)


def episodes(detections: DataFrame, gap: str = GAP) -> DataFrame:
    """Gaps and islands: a detection that starts more than ``gap`` after all
    earlier ones of its type and source have ended opens an episode.

    The window is per type and source over detections, of which a source has
    one a day at most and the whole corpus one per time window and type."""
    w = Window.partitionBy("type", "source").orderBy("started", "ended").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("ended").over(w)
    opens = F.when(reach.isNull() | (F.col("started") > reach + F.expr(f"INTERVAL {gap}")), 1).otherwise(0)
    running = Window.partitionBy("type", "source").orderBy("started", "ended").rowsBetween(Window.unboundedPreceding, 0)
    marked = detections.withColumn("opens", opens).withColumn("episode", F.sum("opens").over(running))
    n = F.count(F.lit(1))
    return (marked.groupBy("type", "source", "episode").agg(
        F.min("started").alias("started"), F.max("ended").alias("ended"), F.sum("count").alias("count"),
        F.max("confidence").alias("confidence"), F.when(n > 1, n).alias("merged_count")).drop("episode"))


def anomaly_episodes(df: DataFrame, gap: str = GAP, cfg: EngineConfig = DEFAULT) -> DataFrame:
    return episodes(daily_detections(df, cfg), gap)

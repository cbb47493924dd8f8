"""Normalisation and one-pass enrichment of a log frame."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..config import DEFAULT, EngineConfig
from ..functions import levels as L
from ..functions import text as X


def normalize_logs(df: DataFrame) -> DataFrame:
    """Level lower-cased, message never null, missing source -> 'unknown'.

    The original analyses default missing keys inconsistently; one rule here.
    """
    fixes = {"level": "lower(coalesce(level, ''))", "message": "coalesce(message, '')",
             "source": "coalesce(source, 'unknown')"}
    return df.selectExpr(*[f"{fixes[c]} AS {c}" if c in fixes else f"`{c}`" for c in df.columns])


def _derived_sql(cfg: EngineConfig) -> dict:
    return {
        "pattern": X.error_pattern_sql("message"),
        "signature": X.message_signature_sql("message"),
        "cluster": X.cluster_signature_sql("message"),
        "response_time": X.response_time_sql("message", cfg.unit_mode),
        "is_broad_error": L.BROAD_SQL,
        "is_narrow_error": L.NARROW_SQL,
        "severity_weight": L.severity_weight_sql("level"),
        "hour": "CAST(hour(log_ts) AS BIGINT)",
        "day": "date_format(log_ts, 'yyyy-MM-dd')",
    }


DERIVED = tuple(_derived_sql(DEFAULT))


def enrich(df: DataFrame, cfg: EngineConfig = DEFAULT, cols=None) -> DataFrame:
    """Add derived per-row columns (pattern, signatures, timing, error flags,
    severity weight, hour, day) - all of them, or only ``cols``.

    Columns already present are kept, so operators can call this on a frame
    that an earlier step enriched.  Deriving only what a query reads keeps
    plan construction cheap; Catalyst would prune the rest anyway.
    """
    want = [c for c in (cols or DERIVED) if c not in df.columns]
    if not want:
        return df
    exprs = _derived_sql(cfg)
    return normalize_logs(df).selectExpr("*", *[f"{exprs[c]} AS {c}" for c in want])

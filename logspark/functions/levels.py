"""Level, status and score classification expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BROAD_ERROR_LEVELS, NARROW_ERROR_LEVELS, VALID_INGEST_LEVELS

# fixed values: severity weight per level; any other level weighs 1
SEVERITY_WEIGHTS = {"fatal": 10.0, "error": 5.0, "warn": 2.0, "info": 1.0, "debug": 0.5}

# fixed values: level ordinals of the service loggers (DEBUG < INFO < WARN < ERROR < FATAL)
LEVEL_ORDINALS = {"DEBUG": 0, "INFO": 1, "WARN": 2, "ERROR": 3, "FATAL": 4}


BROAD_SQL = "level IN (" + ", ".join(f"'{x}'" for x in BROAD_ERROR_LEVELS) + ")"
NARROW_SQL = "level IN (" + ", ".join(f"'{x}'" for x in NARROW_ERROR_LEVELS) + ")"


def severity_weight_sql(level: str = "level") -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v}D" for k, v in SEVERITY_WEIGHTS.items())
    return f"CASE {level} {whens} ELSE 1.0D END"


def norm_level(level: Column) -> Column:
    return F.lower(F.coalesce(level, F.lit("")))


def is_broad_error(level: Column) -> Column:
    """error, fatal or warn (level already lower-cased)."""
    return level.isin(*BROAD_ERROR_LEVELS)


def is_narrow_error(level: Column) -> Column:
    return level.isin(*NARROW_ERROR_LEVELS)


def severity_weight(level: str = "level") -> Column:
    return F.expr(severity_weight_sql(level))


def is_valid_ingest_level(level: Column) -> Column:
    return F.coalesce(level.isin(*VALID_INGEST_LEVELS), F.lit(False))


def level_ordinal(name: Column) -> Column:
    """Ordinal of an upper-case level name as parsed by the service loggers:
    WARNING is WARN, anything unknown is INFO."""
    c = F.when(name == "WARNING", F.lit(2))
    for k, v in LEVEL_ORDINALS.items():
        c = c.when(name == k, F.lit(v))
    return c.otherwise(F.lit(1))


def level_name(ordinal: Column) -> Column:
    c = None
    for k, v in LEVEL_ORDINALS.items():
        c = F.when(ordinal == v, F.lit(k)) if c is None else c.when(ordinal == v, F.lit(k))
    return c.otherwise(F.lit("UNKNOWN"))


def sniff_level(line: Column) -> Column:
    """Level of a raw text line: first hit wins in the order error, warn, debug, fatal."""
    c = None
    for lv in ("error", "warn", "debug", "fatal"):
        hit = line.contains(lv.upper()) | line.contains(lv)
        c = F.when(hit, F.lit(lv)) if c is None else c.when(hit, F.lit(lv))
    return c.otherwise(F.lit("info"))


def status_severity(status: Column) -> Column:
    return (F.when(status >= 500, F.lit("error"))
             .when(status >= 400, F.lit("warn"))
             .otherwise(F.lit("info")))


def reliability_grade(score: Column) -> Column:
    return (F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C")
             .when(score >= 60, "D").otherwise("F"))


def health_status(error_rate: Column) -> Column:
    return (F.when(error_rate < 1, "excellent").when(error_rate < 5, "good")
             .when(error_rate < 15, "warning").otherwise("critical"))


def z_score(v: Column, mean: Column, std: Column) -> Column:
    return F.when(std == 0, F.lit(0.0)).otherwise((v - mean) / std)


def confidence(z: Column) -> Column:
    return F.least(F.abs(z) / 3.0, F.lit(1.0))

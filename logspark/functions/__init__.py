"""Column-level functions (pure Spark expressions)."""

from .levels import (confidence, health_status, is_broad_error, is_narrow_error,  # noqa: F401
                     is_valid_ingest_level, level_name, level_ordinal, norm_level,
                     reliability_grade, severity_weight, sniff_level, status_severity, z_score)
from .text import (cluster_signature, error_pattern, message_signature,  # noqa: F401
                   response_time, strip, terms, truncate)

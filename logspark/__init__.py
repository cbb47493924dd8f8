"""logspark: Spark-native log analytics.

Subpackages: ``functions`` (column expressions), ``sources`` (readers, views,
ingest), ``operators`` (analyses), ``plans`` (report assembly and the query
registry), ``sinks`` (writers), ``streaming`` (Structured Streaming jobs).
"""

from .config import DEFAULT, EngineConfig, get_session  # noqa: F401

__version__ = "0.1.0"

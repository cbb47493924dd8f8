"""Import every query module once and expose the registered queries."""

from __future__ import annotations


def _load():
    from . import catalog  # noqa: F401
    from . import catalog_more  # noqa: F401
    from . import catalog_ingest  # noqa: F401
    from . import catalog_report  # noqa: F401
    from . import catalog_sections  # noqa: F401
    from . import catalog_records  # noqa: F401
    from . import catalog_carried  # noqa: F401
    from . import catalog_stored  # noqa: F401
    return catalog


def all_queries():
    return _load().QUERIES


def all_oracle_sql():
    return _load().ORACLE

"""All queries over the court tables, and their SQL twins."""

from __future__ import annotations

from importlib import import_module

from .base import Query

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

for _name in ("geometry", "scan_clean", "formation", "tactics", "scoring", "events", "teams", "learning", "measures", "court", "colours", "models", "files"):
    try:
        _module = import_module(f"courtline.plans.{_name}")
    except ModuleNotFoundError as _error:
        if _error.name != f"courtline.plans.{_name}":
            raise
        continue
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL

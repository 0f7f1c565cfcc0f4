"""All of the library's queries with their DuckDB SQL."""

from __future__ import annotations

from quire.plans import page_queries, source_queries, table_queries  # noqa: F401  (registers)
from quire.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

"""Every query of the library by name, with the same query in DuckDB's SQL."""

from __future__ import annotations

from . import panel, scenarios

QUERIES = dict(panel.QUERIES) | scenarios.QUERIES
ORACLE = dict(panel.ORACLE) | scenarios.ORACLE

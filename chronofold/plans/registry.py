"""Every registered query of the market-data operators and its DuckDB SQL."""

from __future__ import annotations

from . import domain, joins_sets, model_queries, windows
from .catalog import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "domain", "joins_sets", "model_queries", "windows"]

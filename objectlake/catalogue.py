"""All object-lake queries and their DuckDB equivalents."""

from __future__ import annotations

from .plans import data, edited, gold, identity, ingest, log, monitor, sets
from .plans.registry import Query

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
for _part in (sets, data, ingest, identity, log, monitor, edited, gold):
    QUERIES |= _part.R.queries
    ORACLES |= _part.R.sql

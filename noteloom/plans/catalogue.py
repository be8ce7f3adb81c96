"""All registered queries and the SQL they are checked against."""

from __future__ import annotations

from noteloom.plans import documents, evaluation, search, syncing, upkeep

_PARTS = (documents, search, evaluation, upkeep, syncing)

QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}

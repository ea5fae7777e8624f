"""The library's queries over the test tables, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from millrace.plans import curation, evaluation, execution, generation, text

_PARTS = (evaluation, curation, text, generation, execution)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}

"""All registered queries of the engine's own operators, and their SQL."""

from __future__ import annotations

from . import archive, meetings, names, records, spans, streams, texts, voices

_MODULES = (archive, meetings, records, spans, texts, names, voices, streams)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}

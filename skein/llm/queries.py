"""The registered queries of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from . import decontaminate, language, licenses, near_dup, packing, periodic_runs, prefix_trie, quality, quality_rules, secrets, substring_dup, token_counts, token_files

_MODULES = (near_dup, secrets, token_files, substring_dup, quality, language, licenses, packing, decontaminate, quality_rules, periodic_runs, prefix_trie, token_counts)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in getattr(module, "ORACLE_SQL", {}).items()}

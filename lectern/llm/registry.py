"""All queries of this package and their SQL."""

from __future__ import annotations

from lectern.llm import queries_match, queries_mixing, queries_names, queries_packing, queries_pieces, queries_scans, queries_spans, queries_survivor

_MODULES = (queries_match, queries_mixing, queries_names, queries_packing, queries_pieces, queries_scans, queries_spans, queries_survivor)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}

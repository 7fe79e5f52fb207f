"""All queries of the core and their SQL."""

from __future__ import annotations

from lectern.plans import documents, functions, hierarchy, layout, relational

_MODULES = (documents, functions, hierarchy, layout, relational)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}

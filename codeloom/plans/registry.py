"""All queries of the core and their oracle SQL."""

from __future__ import annotations

from . import activity, ask, code_graph, corpus

MODULES = (code_graph, activity, ask, corpus)
QUERIES = {name: f for module in MODULES for name, f in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in module.ORACLE.items()}

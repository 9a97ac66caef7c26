"""Registry of the engine's own queries and of the SQL they are held against."""

from __future__ import annotations

from . import query_basics, query_features, query_metrics, query_population, query_sources, query_triage

_MODULES = (query_basics, query_features, query_population, query_metrics, query_triage, query_sources)
FLAGSHIP = "a5_rise_rates"
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in _MODULES for k, s in m.ORACLE.items()}

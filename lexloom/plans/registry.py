"""All queries of the engine's own operators and their SQL."""

from __future__ import annotations

from . import corpus, dataset, evaluation, files, ingest, learned, linking, retrieval, rules, streams

_MODULES = (evaluation, corpus, linking, retrieval, rules, ingest, dataset, files, learned, streams)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}

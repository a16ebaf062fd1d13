"""All queries of the core and their SQL."""

from __future__ import annotations

from . import documents, records, retrieval, scalar, tables

MODULES = [scalar, documents, retrieval, tables, records]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}

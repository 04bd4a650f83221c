"""Registered queries of the core and their SQL twins."""

from __future__ import annotations

from tessera.plans import indexing, references, retrieval

QUERIES = {**retrieval.QUERIES, **indexing.QUERIES, **references.QUERIES}
ORACLE_SQL = {**retrieval.ORACLE_SQL, **indexing.ORACLE_SQL, **references.ORACLE_SQL}

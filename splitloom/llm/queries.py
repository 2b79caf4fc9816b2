"""Queries on training data and the SQL they are compared with."""

from __future__ import annotations

from splitloom.llm import queries_records, queries_texts

_PARTS = [queries_records, queries_texts]
QUERIES = {k: f for m in _PARTS for k, f in m.QUERIES.items()}
SQL = {k: s for m in _PARTS for k, s in m.SQL.items()}

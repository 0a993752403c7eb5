"""Queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from wavecrest.plans import decode_queries, file_queries, signal_queries, slot_queries, stream_queries, token_queries

_PARTS = (signal_queries, token_queries, file_queries, decode_queries, slot_queries, stream_queries)
QUERIES = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
ORACLES = {k: v for p in _PARTS for k, v in p.ORACLES.items()}

"""Registered queries and their SQL."""

from vellum.catalog import chunking, cleaning, documents, incremental, items, search, store

_PARTS = (chunking, cleaning, documents, incremental, items, search, store)

QUERIES = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
SQL = {k: v for p in _PARTS for k, v in p.SQL.items()}

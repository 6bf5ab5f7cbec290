"""Queries of the library by name, and equivalent SQL where it can be stated."""
from __future__ import annotations

from corpusloom.operators import library_queries, nested_queries, queries

PARTS = (queries, library_queries, nested_queries)
QUERIES = {name: query for part in PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in PARTS for name, sql in part.ORACLES.items()}

"""All queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import model_queries, native_queries

QUERIES = {**native_queries.QUERIES, **model_queries.QUERIES}
SQL = {**native_queries.SQL, **model_queries.SQL}

"""Ready-made queries over the given tables, each with the SQL it must equal."""

from . import cleaning, conversation, corpus, live, matching, records, retrieval, usage  # noqa: F401
from .catalog import QUERIES, Query, oracle_sql, queries

__all__ = ["QUERIES", "Query", "oracle_sql", "queries"]

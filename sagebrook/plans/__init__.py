"""Registered queries on the given tables, with their DuckDB equivalents."""

from . import queries_cases, queries_core, queries_grid, queries_more, queries_text, queries_values
from .registry import QUERIES, SQL

FLAGSHIP = "hybrid_search"


def queries():
    return QUERIES


def oracle_sql():
    return SQL

"""Every operator as a query over the test tables."""

from attest.queries import access, catalog, content, fields, graph, history, rules, streams  # noqa: F401
from attest.queries.registry import QUERIES, Query, Tables

__all__ = ["QUERIES", "Query", "Tables"]

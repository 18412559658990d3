"""All queries of the core and their SQL counterparts."""

from __future__ import annotations

from waymill.plans import data_queries, network_queries, route_queries, source_queries

QUERIES = {**data_queries.QUERIES, **network_queries.QUERIES, **route_queries.QUERIES, **source_queries.QUERIES}
ORACLE = {**data_queries.ORACLE, **network_queries.ORACLE, **route_queries.ORACLE, **source_queries.ORACLE}

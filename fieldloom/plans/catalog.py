"""Registered queries and their SQL equivalents."""

from __future__ import annotations

from fieldloom.plans import grouped_queries, relational_queries, source_queries, statistical_queries, streaming_queries

QUERIES: dict = relational_queries.QUERIES | statistical_queries.QUERIES | grouped_queries.QUERIES | source_queries.QUERIES | streaming_queries.QUERIES
ORACLES: dict = relational_queries.ORACLES | statistical_queries.ORACLES | source_queries.ORACLES | streaming_queries.ORACLES
FLAGSHIP = "kalman_filter"

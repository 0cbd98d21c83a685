"""All driver queries of the core library with their oracle SQL."""

from __future__ import annotations

from . import dataset_queries, filing_queries, letter_queries, linkage_queries, listing_queries, panel_queries, report_queries, stream_queries, temporal_queries, text_queries

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for module in (temporal_queries, panel_queries, linkage_queries, text_queries, dataset_queries, filing_queries, listing_queries, report_queries, stream_queries, letter_queries):
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL

"""The registered queries of the fusion engine and their SQL."""

from __future__ import annotations

from loomfuse.plans import fusion_queries, text_queries

QUERIES = text_queries.QUERIES | fusion_queries.QUERIES
SQL = text_queries.SQL | fusion_queries.SQL
flagship = fusion_queries.flagship

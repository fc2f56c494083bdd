"""The queries of the text operators and their SQL."""

from __future__ import annotations

from loomfuse.llm import conversations, decontamination, embeddings, licenses, lines, mixing, packing, phrases, quality, sharding, simhash, token_counts, toxicity

MODULES = [token_counts, lines, decontamination, embeddings, toxicity, packing, sharding, licenses, simhash, quality, phrases, conversations, mixing]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: text for module in MODULES for name, text in module.SQL.items()}

"""All queries of the subpackage and their SQL."""

from __future__ import annotations

from tidemark.llm import conversations, decontaminate, html_text, jaccard_join, manifest, mixing, periodic_runs, pii, quality_rules, sentence_pieces, sharding, token_counts, token_files

_MODULES = (mixing, quality_rules, decontaminate, jaccard_join, token_counts, pii, token_files, sharding, conversations, html_text, manifest, sentence_pieces, periodic_runs)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}

"""Queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from quern.llm import collocations, decontaminate, embedding_dedup, exact_dedup, language_model, near_dedup, packing, pii, quality, secrets, substring_dedup, token_files, vector_codes

MODULES = (pii, decontaminate, secrets, exact_dedup, token_files, language_model, quality, substring_dedup, packing, near_dedup, collocations, vector_codes, embedding_dedup)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}

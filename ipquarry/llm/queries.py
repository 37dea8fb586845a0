"""The registered queries of this subpackage."""

from __future__ import annotations

from ipquarry.llm import byte_bpe, exact_dedup, exact_topk, licenses, near_dup, ngram_lm, packing, quality, secrets, token_counts

_MODULES = [byte_bpe, exact_dedup, exact_topk, licenses, near_dup, ngram_lm, packing, quality, secrets, token_counts]

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}

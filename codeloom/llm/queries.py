"""All queries of this subpackage, with the SQL of those that SQL can express."""

from __future__ import annotations

from . import queries_bpe, queries_collocations, queries_decontaminate, queries_dedup, queries_langid, queries_lm, queries_periodic, queries_pii, queries_pipeline, queries_quality, queries_rankbpe, queries_sharding, queries_topk, queries_urlfilter

_MODULES = (queries_bpe, queries_collocations, queries_decontaminate, queries_dedup, queries_langid, queries_lm, queries_periodic, queries_pii, queries_pipeline, queries_quality, queries_rankbpe, queries_sharding, queries_topk, queries_urlfilter)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}

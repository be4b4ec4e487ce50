"""All queries of this subpackage and their SQL."""

from lexiloom.llm import queries_dedup, queries_leakage, queries_lookalike, queries_size, queries_splits

_MODULES = (queries_lookalike, queries_dedup, queries_splits, queries_leakage, queries_size)
QUERIES = {k: q for m in _MODULES for k, q in m.QUERIES.items()}
ORACLE_SQL = {k: q for m in _MODULES for k, q in m.ORACLE_SQL.items()}

"""All queries of this subpackage and the SQL they are compared with."""

from __future__ import annotations

from corpusloom.llm import cutting_queries, edit_queries, mixing_queries, neighbour_queries, packing_queries, pair_queries, span_queries, stuffing_queries

_MODULES = (pair_queries, neighbour_queries, edit_queries, cutting_queries, span_queries, packing_queries, mixing_queries, stuffing_queries)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}

"""Every registered query and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codelattice.plans import code_queries, graph_queries, java_queries, link_queries, module_queries, retrieval_queries, rule_queries, source_queries, store_queries, table_queries, web_queries

_PARTS = (graph_queries, table_queries, link_queries, code_queries, retrieval_queries, web_queries, java_queries, module_queries, store_queries, source_queries, rule_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for p in _PARTS for k, v in p.ORACLES.items()}

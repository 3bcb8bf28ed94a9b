"""Queries bound to the given tables, and their SQL."""

from . import body_queries, code_queries, context_queries, derived_queries, fact_queries, feature_queries, graph_queries, lookup_queries, prefab_queries, source_queries

ALL = graph_queries.QUERIES | fact_queries.QUERIES | source_queries.QUERIES | context_queries.QUERIES | derived_queries.QUERIES | prefab_queries.QUERIES | body_queries.QUERIES | lookup_queries.QUERIES | code_queries.QUERIES | feature_queries.QUERIES


def queries() -> dict:
    return {name: q for name, (q, _) in ALL.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in ALL.items() if sql}

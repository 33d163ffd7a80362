"""Queries over the given tables and their SQL."""

from __future__ import annotations

from quakeloom.plans import catalog_queries, cluster_queries, feature_queries, metric_queries, model_queries

MODULES = (catalog_queries, cluster_queries, feature_queries, metric_queries, model_queries)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}

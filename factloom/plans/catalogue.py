"""Queries over the given tables, by name, and SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import asset_queries, call_queries, fact_queries, report_queries, route_queries, scanner_queries, search_queries, surface_queries

_PARTS = (search_queries, report_queries, fact_queries, call_queries, route_queries, asset_queries, surface_queries, scanner_queries)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best documents for each benchmark text."""
    return search_queries.search_topk(spark, sf_dir)

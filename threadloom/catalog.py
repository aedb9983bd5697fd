"""Registered queries of the graph and text operators, with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from threadloom.plans import file_queries, graph_oracles, graph_queries, more_queries, text_oracles, text_queries, view_queries
from threadloom.plans.shape import tidy


def _shaped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: tidy(query(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: _shaped(q) for part in (graph_queries, text_queries, view_queries, more_queries, file_queries) for name, q in part.QUERIES.items()
}
ORACLES: dict[str, str] = graph_oracles.ORACLES | text_oracles.ORACLES | view_queries.ORACLES | more_queries.ORACLES | file_queries.ORACLES

"""Registry of the queries over the knowledge-graph operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import canonical, circuits, endpoints, evidence, governance, graph, layers, listings, mentions, networks, papers, services, text

PARTS = [evidence, canonical, endpoints, governance, graph, networks, text, mentions, services, layers, circuits, papers, listings]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: q for part in PARTS for k, q in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: q for part in PARTS for k, q in part.ORACLE_SQL.items()}

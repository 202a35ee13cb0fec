"""The registered queries over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from meshloom.plans import cluster_queries, graph_queries, matrix_queries, other_queries, partition_queries, source_queries  # noqa: F401  they register
from meshloom.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

"""Registered queries: each maps the bundled fixture tables onto an operator
and pairs it with an independent DuckDB SQL formulation of the same result.

``REGISTRY`` maps a query name to ``(spark_fn, oracle_sql_or_None)`` where
``spark_fn(spark, sf_dir) -> DataFrame``.
"""

from __future__ import annotations

from risklens.plans import access_queries, graph_queries, io_queries, learn_queries  # noqa: F401
from risklens.plans.registry import REGISTRY  # noqa: F401

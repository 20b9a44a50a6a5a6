"""Every registered query of the engine with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import code, content, explore, governance, graph, retrieval, search, store, temporal

MODULES = (temporal, search, graph, content, governance, store, code, retrieval, explore)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: s for m in MODULES for k, s in m.ORACLES.items()}
FLAGSHIP = "fact_current_by_predicate"

"""All queries of the library outside the llm subpackage, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .jobs import cell_queries, detect_queries, mixture_queries, point_queries, source_queries, voxel_queries

_MODULES = (cell_queries, voxel_queries, detect_queries, mixture_queries, point_queries, source_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE: dict[str, str] = {k: s for m in _MODULES for k, s in m.ORACLE.items()}

"""All registered queries of the library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliant.plans import answer_queries, store_queries, text_queries


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**text_queries.QUERIES, **answer_queries.QUERIES, **store_queries.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: q.oracle() for name, q in QUERIES.items() if hasattr(q, "oracle")}

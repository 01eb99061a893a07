"""The registered queries over the given tables, and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.plans import catalog_queries, chunk_queries, corpus_queries, evidence_queries, search_queries, step_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**corpus_queries.QUERIES, **catalog_queries.QUERIES, **chunk_queries.QUERIES, **search_queries.QUERIES, **evidence_queries.QUERIES, **step_queries.QUERIES}
ORACLE_SQL: dict[str, str] = {**corpus_queries.ORACLE_SQL, **catalog_queries.ORACLE_SQL, **chunk_queries.ORACLE_SQL, **search_queries.ORACLE_SQL, **evidence_queries.ORACLE_SQL, **step_queries.ORACLE_SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions to packed contexts: keyword search, rerank, context packing."""
    return search_queries.final_context(spark, sf_dir)

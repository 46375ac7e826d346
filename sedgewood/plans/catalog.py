"""All registered queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sedgewood.plans import evaluation_queries, graph_queries, job_queries, retrieval_queries, source_queries, table_queries, text_queries
from sedgewood.plans.registry import QUERIES, SQL, Query

_MODULES = (source_queries, table_queries, text_queries, retrieval_queries, graph_queries, job_queries, evaluation_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit rate and reciprocal rank of BM25 and hybrid retrieval of benchmark passages."""
    return retrieval_queries.retrieval_summary(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

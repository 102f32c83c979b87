"""All queries of the library by name, with DuckDB's SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ruleloom.plans import corpus_queries, dense_queries, flow_queries, table_queries, topic_queries

QUERIES = {**corpus_queries.QUERIES, **table_queries.QUERIES, **topic_queries.QUERIES, **dense_queries.QUERIES, **flow_queries.QUERIES}
ORACLE_SQL = {**corpus_queries.ORACLE_SQL, **table_queries.ORACLE_SQL, **topic_queries.ORACLE_SQL, **dense_queries.ORACLE_SQL, **flow_queries.ORACLE_SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document: revisions that are material, editorial or undecided."""
    return QUERIES["funnel"](spark, sf_dir)

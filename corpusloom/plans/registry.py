"""All queries of the core and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.plans import evaluation, gates, integrity, quality, retrieval

_MODULES = (integrity, retrieval, evaluation, gates, quality)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query the driver smoke-tests: the five best chunks of every twentieth question."""
    return QUERIES["q_bm25_top5"](spark, sf_dir)

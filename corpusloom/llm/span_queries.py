"""Queries of problem 5: spans that stand verbatim in more than one record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.spans import shared_records
from corpusloom.runtime import table

LEAST = 120


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    """For each chunk and fact with a shared span: how much of its text stands elsewhere too."""
    chunks = table(spark, d, "chunks").select(F.lit("chunks").alias("record_table"), F.col("id").alias("record_id"), "text")
    facts = table(spark, d, "resume_facts").select(F.lit("resume_facts").alias("record_table"), F.col("id").alias("record_id"), F.col("source_text").alias("text"))
    return shared_records(chunks.unionByName(facts), LEAST)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The records with a span of at least 120 code points in common with another record."""
    return p5_records(spark, d).select("record_table", "record_id")


QUERIES = {"p5_found": p5_found, "p5_records": p5_records}

ORACLE = {
    "p5_found": f"""
WITH rec AS (
  SELECT 'chunks' AS record_table, id AS record_id, text AS x FROM chunks WHERE id IS NOT NULL AND length(text) >= {LEAST}
  UNION SELECT 'resume_facts', id, source_text FROM resume_facts WHERE id IS NOT NULL AND length(source_text) >= {LEAST}),
win AS (SELECT DISTINCT record_table, record_id, hash(substring(x, i, {LEAST})) AS h FROM (SELECT *, unnest(range(1, length(x) - {LEAST} + 2)) AS i FROM rec)),
met AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1)
SELECT DISTINCT record_table, record_id FROM win JOIN met USING (h)""",
}

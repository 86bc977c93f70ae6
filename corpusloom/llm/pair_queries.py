"""Queries of problem 1: question and answer pairs whose answer is unusable."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.pairs import defective_pairs
from corpusloom.runtime import table


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    newest = lambda c, at: F.max_by(c, F.struct(F.col(at), F.col("answer"))).alias(c)
    asked = table(spark, d, "resume_qa_pairs").where("id IS NOT NULL").withColumn("answer", F.col("expected_answer"))
    asked = asked.groupBy("id").agg(*(newest(c, "ingested_at") for c in ("question", "answer", "answerable")))
    made = table(spark, d, "generation_results").where("id IS NOT NULL").withColumn("answer", F.col("answer_text"))
    made = made.groupBy("id").agg(*(newest(c, "generated_at") for c in ("question", "answer", "qa_id")))
    made = made.join(asked.select(F.col("id").alias("qa_id"), "answerable"), "qa_id", "left")
    cols = [F.col("id").alias("pair_id"), "question", "answer", "answerable"]
    return asked.select(F.lit("resume_qa_pairs").alias("pair_table"), *cols).unionByName(made.select(F.lit("generation_results").alias("pair_table"), *cols))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every defective pair with its one defect."""
    return defective_pairs(_pairs(spark, d))


QUERIES = {"p1_found": p1_found}
ORACLE: dict[str, str] = {}

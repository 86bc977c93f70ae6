"""Queries of problem 9: keyword-stuffed and link-list pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.stuffing import page_curves, stuffed_pages
from corpusloom.runtime import stage, table


def _stuffed(spark: SparkSession, d: str) -> DataFrame:
    # The curves are used for the norms and again for the verdict; a few numbers per page are written once.
    return stuffed_pages(stage(page_curves(table(spark, d, "documents"), "doc_id", "text"), "curves"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """The stuffed pages."""
    return _stuffed(spark, d).where("kind IS NOT NULL").select("doc_id")


def p9_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every page with its curve and verdict."""
    return _stuffed(spark, d)


QUERIES = {"p9_found": p9_found, "p9_pages": p9_pages}
ORACLE: dict[str, str] = {}

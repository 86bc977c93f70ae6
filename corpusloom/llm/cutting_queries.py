"""Queries of problem 4: pieces of oversized documents and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.splitting import split_oversized
from corpusloom.runtime import table


def _limit(spark: SparkSession, d: str, limit_id: str) -> tuple[int, int]:
    row = table(spark, d, "size_limits").where(F.col("limit_id") == limit_id).select("max_size", "overlap").first()
    return row["max_size"], row["overlap"]


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All pieces of all oversized documents and chunks, with their text and offsets."""
    docs = split_oversized(table(spark, d, "documents"), "doc_id", "text", *_limit(spark, d, "document_piece"), newest="loaded_at")
    chunks = split_oversized(table(spark, d, "chunks"), "id", "text", *_limit(spark, d, "chunk_piece"), newest="loaded_at")
    return docs.select(F.lit("documents").alias("item_table"), "*").unionByName(chunks.select(F.lit("chunks").alias("item_table"), "*"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The items that had to be cut."""
    return p4_pieces(spark, d).where("piece_index > 0").select("item_table", "item_key").distinct()


QUERIES = {"p4_found": p4_found, "p4_pieces": p4_pieces}

ORACLE = {
    "p4_found": """
SELECT DISTINCT 'documents' AS item_table, CAST(doc_id AS VARCHAR) AS item_key FROM documents WHERE length(text) > (SELECT max_size FROM size_limits WHERE limit_id = 'document_piece')
UNION ALL SELECT DISTINCT 'chunks', id FROM chunks WHERE length(text) > (SELECT max_size FROM size_limits WHERE limit_id = 'chunk_piece')""",
}

"""An extension: chunking and tokenising documents as they arrive.

BM25's statistics are of the whole corpus, so scoring stays a batch job; what can be done per document is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.functions.text import normal_text, tokens
from corpusloom.operators.chunking import chunk


def arriving_chunks(documents: DataFrame) -> DataFrame:
    """Chunks of a (streaming) frame of document_id and text, with their token counts; stateless."""
    return chunk(documents.select("document_id", normal_text(F.col("text")).alias("text"))).withColumn("n_tokens", F.size(tokens(F.col("text"))))


def ingest(documents: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the chunks of arriving documents to a Parquet table, each once; ends when the input is used up."""
    return arriving_chunks(documents).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def loads_per_hour(rows: DataFrame, at: str = "loaded_at", late: str = "1 day") -> DataFrame:
    """Rows per hour of arrival under a watermark; rows later than ``late`` are not counted."""
    return rows.withWatermark(at, late).groupBy(F.window(at, "1 hour")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), "n")

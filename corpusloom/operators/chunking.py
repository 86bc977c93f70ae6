"""Chunks of documents: paragraphs between blank lines, and cuts of those that are too long.

Only offsets are found in Python (regular-expression positions have no SQL form); texts are cut by Spark.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.ids import chunk_id

#: Longest chunk in code points.
LIMIT = 1000
# Fixed value: what separates paragraphs.
_GAP = re.compile(r"\n[ \t]*\n[ \t\n]*")


def paragraph_spans(text: str) -> list[tuple[int, int]]:
    """Stretches between blank lines, without white space at their ends, none empty."""
    edges = [0, *(x for m in _GAP.finditer(text) for x in m.span()), len(text)]
    out = []
    for a, b in zip(edges[::2], edges[1::2]):
        inner = text[a:b]
        left = len(inner) - len(inner.lstrip())
        if left < len(inner):
            out.append((a + left, a + len(inner.rstrip())))
    return out


@functools.cache
def _pieces(limit: int) -> re.Pattern:
    """One piece and the white space after it: the rest if it fits, else as much as ends before a space, else a
    full piece."""
    return re.compile(rf"(?P<piece>.{{1,{limit}}}\Z|.{{1,{max(1, limit - 1)}}}(?= )|.{{{limit}}})\s*", re.DOTALL)


def chunk_spans(text: str, limit: int = LIMIT) -> list[tuple[int, int]]:
    """All chunks of a text in reading order: its paragraphs, those over ``limit`` as pieces."""
    return [m.span("piece") for a, b in paragraph_spans(text) for m in _pieces(limit).finditer(text, a, b)]


def chunk(documents: DataFrame, key: str = "document_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """(id, document_id, text, chunk_index, character_start, character_end): the chunks of every document.

    Null and blank texts have none. Offsets are half-open in code points.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        for batch in batches:
            spans = [[{"a": a, "b": b} for a, b in chunk_spans(t, limit)] for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("document_id"), batch.column("t"), pa.array(spans, kind)], names=["document_id", "t", "spans"])

    rows = documents.where(F.col(text).isNotNull()).select(F.col(key).alias("document_id"), F.col(text).alias("t"))
    kind = dict(rows.dtypes)["document_id"]
    spans = rows.mapInArrow(run, f"document_id {kind}, t string, spans array<struct<a:int,b:int>>")
    return spans.select("document_id", "t", F.posexplode("spans").alias("chunk_index", "s")).select(
        chunk_id(F.col("document_id"), F.col("chunk_index")).alias("id"), "document_id", F.substring("t", F.col("s.a") + 1, F.col("s.b") - F.col("s.a")).alias("text"), "chunk_index", F.col("s.a").alias("character_start"), F.col("s.b").alias("character_end")
    )


def index_gaps(chunks: DataFrame) -> DataFrame:
    """Chunks whose index is not their place (from 0) among their document's chunks."""
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_index", "id")) - 1
    return chunks.withColumn("place", place).where(F.col("place") != F.col("chunk_index")).select("document_id", "id", "chunk_index", "place")


def overlaps(chunks: DataFrame) -> DataFrame:
    """Chunks that end after the next one of their document begins."""
    following = F.lead("character_start").over(Window.partitionBy("document_id").orderBy("chunk_index", "id"))
    return chunks.withColumn("next_start", following).where(F.col("character_end") > F.col("next_start")).select("document_id", "id", "character_end", "next_start")


def reconstruction_failures(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks whose text is not what their offsets cut from their document; chunks without one are orphans."""
    joined = chunks.join(documents.select("document_id", F.col("text").alias("whole")), "document_id", "left")
    fits = F.substring("whole", F.col("character_start") + 1, F.col("character_end") - F.col("character_start")) == F.col("text")
    return joined.where(~F.coalesce(fits, F.lit(False))).select("document_id", "id", F.when(F.col("whole").isNull(), "no document").when(F.col("character_start").isNull() | F.col("character_end").isNull() | F.col("text").isNull(), "incomplete").otherwise("differs").alias("reason"))

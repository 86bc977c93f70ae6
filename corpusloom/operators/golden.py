"""Golden facts located in documents and chunks, and evidence traces derived from question pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Labels of derived trace entries.
MULTI_HOP, SINGLE_HOP, NO_ANSWER, ABSTAIN, ANSWER = "Multi-hop", "Single-hop", "No Answer", "Abstain", "Answer"


def fact_spans(facts: DataFrame, documents: DataFrame) -> DataFrame:
    """(fact_id, document_id, start, end, occurrences): where each fact's source text stands in its document.

    ``start`` is -1 where it does not stand. Offsets are code points; occurrences do not overlap. Facts
    without source text, or whose document does not exist or has no text, have no row.
    """
    f = facts.where("source_text IS NOT NULL AND source_text <> ''").select(F.col("id").alias("fact_id"), "document_id", "source_text")
    x = f.join(documents.where("text IS NOT NULL").select("document_id", "text"), "document_id")
    start = F.position(F.col("source_text"), F.col("text")) - 1
    count = F.floor((F.length("text") - F.length(F.replace("text", F.col("source_text"), F.lit("")))) / F.length("source_text"))
    return x.select("fact_id", "document_id", start.cast("int").alias("start"), F.when(start >= 0, start + F.length("source_text")).otherwise(-1).cast("int").alias("end"), count.cast("int").alias("occurrences"))


def fact_chunks(spans: DataFrame, chunks: DataFrame) -> DataFrame:
    """(fact_id, chunk_id, chunk_index): the chunks of a fact's document that overlap its span.

    An equi-join on the document with the overlap of intervals as its residual condition.
    """
    s = spans.where("start >= 0").alias("s")
    c = chunks.alias("c")
    meet = (F.col("c.document_id") == F.col("s.document_id")) & (F.col("c.character_end") > F.col("s.start")) & (F.col("c.character_start") < F.col("s.end"))
    return s.join(c, meet).select("s.fact_id", F.col("c.id").alias("chunk_id"), "c.chunk_index")


def evidence_trace(pairs: DataFrame, facts: DataFrame, located: DataFrame) -> DataFrame:
    """Trace entries of question pairs, with a reason where none can be derived.

    A pair's evidence is its fact and its supporting facts; they must all exist, lie in one document, and
    touch at least one chunk. Columns: id, qa_id, expected_source, expected_chunk (sorted), reasoning_type,
    outcome, error (null, 'unknown fact', 'several documents' or 'no chunk').
    """
    keys = F.array_distinct(F.filter(F.concat(F.array("fact_id"), F.coalesce("supporting_fact_ids", F.array().cast("array<string>"))), lambda k: k.isNotNull() & (F.trim(k) != "")))
    wanted = pairs.select(F.col("id").alias("qa_id"), F.explode_outer(keys).alias("fact_id"))
    known = wanted.join(facts.select(F.col("id").alias("fact_id"), "document_id", F.lit(1).alias("known")), "fact_id", "left")
    chunks = located.groupBy("fact_id").agg(F.collect_set("chunk_id").alias("chunks"))
    per = known.join(chunks, "fact_id", "left").groupBy("qa_id").agg(
        F.count_if(F.col("known").isNull()).alias("unknown"), F.count_distinct("document_id").alias("documents"), F.min("document_id").alias("document"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("chunks")))).alias("chunks")
    )
    error = F.when(F.col("unknown") > 0, "unknown fact").when(F.col("documents") > 1, "several documents").when(F.size("chunks") == 0, "no chunk")
    supports = F.size(F.filter(F.coalesce("supporting_fact_ids", F.array().cast("array<string>")), lambda k: k.isNotNull()))
    return pairs.select(F.col("id").alias("qa_id"), supports.alias("n"), "failure_category").join(per, "qa_id").select(
        F.concat(F.lit("meta_"), "qa_id").alias("id"), "qa_id", F.when(error.isNull(), F.col("document")).alias("expected_source"), F.when(error.isNull(), F.col("chunks")).alias("expected_chunk"),
        F.when(F.col("n") >= 2, MULTI_HOP).otherwise(SINGLE_HOP).alias("reasoning_type"), F.when(F.col("failure_category") == NO_ANSWER, ABSTAIN).otherwise(ANSWER).alias("outcome"), error.alias("error"),
    )

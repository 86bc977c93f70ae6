"""Prompts assembled from retrieved chunks, answers quoted from them, and execution traces.

Whatever has texts or a row per question is sorted and merged: repeated passages take little space in a file, so the
planner takes them for small, and would pass their texts through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Separators, and the answer given where there is no evidence.
CONTEXT_SEPARATOR, ANSWER_SEPARATOR = "\n\n", "\n"
ABSTENTION = "No supporting evidence was retrieved for this query."


def resolved(retrieved: DataFrame, chunks: DataFrame) -> DataFrame:
    """Retrieved ids (query_id, rank, id) with their chunks' columns; ids that resolve to none have null text."""
    return retrieved.select("query_id", "rank", "id").join(chunks.select("id", "document_id", "text", "character_start", "character_end").hint("merge"), "id", "left")


def unresolved(retrieved: DataFrame, chunks: DataFrame) -> DataFrame:
    """Retrieved ids without a chunk; assembling them is an error."""
    return retrieved.select("query_id", "rank", "id").join(chunks.select("id"), "id", "left_anti")


def prompts(queries: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, question, context, chunk_ids, provenance): passages in rank order, joined by blank lines.

    Questions without passages have an empty context. A prompt holds at most the k passages retrieved.
    """
    item = F.struct("rank", "id", "document_id", "character_start", "character_end", "text")
    per = passages.where("text IS NOT NULL").groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("x"))
    x = queries.select("query_id", "question").join(per.hint("merge"), "query_id", "left").withColumn("x", F.coalesce("x", F.array().cast("array<struct<rank:int,id:string,document_id:string,character_start:int,character_end:int,text:string>>")))
    return x.select(
        "query_id", "question", F.array_join(F.transform("x", lambda p: p["text"]), CONTEXT_SEPARATOR).alias("context"), F.transform("x", lambda p: p["id"]).alias("chunk_ids"),
        F.transform("x", lambda p: F.struct(p["id"].alias("chunk_id"), p["document_id"].alias("document_id"), p["character_start"].alias("character_start"), p["character_end"].alias("character_end"))).alias("provenance"),
    )


def passage_offsets(passages: DataFrame) -> DataFrame:
    """(query_id, rank, id, context_start, context_end): where each passage stands in its prompt's context.

    A running sum of lengths and separators, so separators inside passages do no harm.
    """
    before = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + len(CONTEXT_SEPARATOR)).over(before), F.lit(0))
    return passages.where("text IS NOT NULL").select("query_id", "rank", "id", start.cast("int").alias("context_start"), (start + F.length("text")).cast("int").alias("context_end"))


def inconsistent_prompts(assembled: DataFrame, offsets: DataFrame) -> DataFrame:
    """Prompts whose passages do not add up to their context."""
    total = offsets.groupBy("query_id").agg(F.max("context_end").alias("n"), F.count("*").alias("passages"))
    x = assembled.join(total, "query_id", "left")
    return x.where((F.length("context") != F.coalesce("n", F.lit(0))) | (F.size("chunk_ids") != F.coalesce("passages", F.lit(0)))).select("query_id")


def answers(queries: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, answer_text, outcome, statements): each passage quoted as one statement; abstention without any."""
    per = passages.where("text IS NOT NULL").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text", "id", "document_id", "character_start", "character_end"))).alias("x"))
    x = queries.select("query_id").join(per.hint("merge"), "query_id", "left")
    some = F.size(F.coalesce("x", F.array().cast("array<struct<rank:int,text:string,id:string,document_id:string,character_start:int,character_end:int>>"))) > 0
    statements = F.transform("x", lambda p: F.struct(p["text"].alias("text"), F.array(F.struct(p["id"].alias("chunk_id"), p["document_id"].alias("document_id"))).alias("supporting_evidence")))
    return x.select(
        "query_id", F.when(some, F.array_join(F.transform("x", lambda p: p["text"]), ANSWER_SEPARATOR)).otherwise(ABSTENTION).alias("answer_text"), F.when(some, "Answer").otherwise("Abstain").alias("outcome"),
        F.coalesce(statements, F.array().cast("array<struct<text:string,supporting_evidence:array<struct<chunk_id:string,document_id:string>>>>")).alias("statements"),
    )


def traces(queries: DataFrame, candidates: DataFrame, assembled: DataFrame, answered: DataFrame, k: int) -> DataFrame:
    """One nested record per question: candidates with their route ranks, provenance, generation."""
    c = candidates.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "semantic_rank", "lexical_rank", "score", (F.col("rank") <= k).alias("selected")))).alias("candidates"))
    return (
        queries.select("query_id", "question").join(c.hint("merge"), "query_id", "left").join(assembled.select("query_id", "chunk_ids", "provenance").hint("merge"), "query_id", "left").join(answered.hint("merge"), "query_id", "left")
        .select("query_id", F.struct("question").alias("query"), F.struct(F.lit("fused").alias("route"), F.lit(k).alias("top_k"), "candidates").alias("retrieval"), F.struct("chunk_ids", "provenance").alias("assembly"), F.struct("outcome", "answer_text", "statements").alias("generation"))
    )


def trace_violations(records: DataFrame) -> DataFrame:
    """(query_id, problem): selections that do not lead, provenance unlike the prompt, evidence from elsewhere."""
    chosen = F.transform(F.filter("retrieval.candidates", lambda c: c["selected"]), lambda c: c["id"])
    leading = F.slice(F.transform("retrieval.candidates", lambda c: c["id"]), 1, F.greatest(F.size(chosen), F.lit(1)))
    evidence = F.flatten(F.transform("generation.statements", lambda s: F.transform(s["supporting_evidence"], lambda e: e["chunk_id"])))
    provenance = F.transform("assembly.provenance", lambda p: p["chunk_id"])
    problem = (
        F.when((F.size(chosen) > 0) & (chosen != leading), "selected are not the leading candidates")
        .when(provenance != F.col("assembly.chunk_ids"), "provenance differs from prompt")
        .when(F.size(F.array_except(evidence, provenance)) > 0, "evidence outside provenance")
        .when(F.size(F.array_except(provenance, F.coalesce(F.transform("retrieval.candidates", lambda c: c["id"]), F.array().cast("array<string>")))) > 0, "provenance outside candidates")
    )
    return records.select("query_id", problem.alias("problem")).where("problem IS NOT NULL")

"""The reference tables as the operators take them, and the same in SQL for comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.ids import canonical_rank
from corpusloom.runtime import table

#: Every twentieth question (by the number of its fact) is a query; it is asked of the whole corpus.
QUERY_STEP = 20


def latest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row per key: the one with the greatest ``order``."""
    kept = F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("x")
    return rows.groupBy(F.col(key).alias("_key")).agg(kept).select("x.*")


def documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents with text."""
    return table(spark, d, "documents").where("text IS NOT NULL").select("document_id", "text", "doc_id")


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """(id, source, hash, canonical): the entries that are not deleted, one per id."""
    live = table(spark, d, "manifest").where("deleted_at IS NULL").select("id", "source", "hash", F.coalesce("canonical", F.lit(False)).alias("canonical"), "loaded_at")
    return latest(live, "id", F.col("loaded_at"), F.coalesce("hash", F.lit(""))).drop("loaded_at")


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """The chunks that are not deleted, one per id, with the place of their document in the corpus."""
    live = table(spark, d, "chunks").where("deleted_at IS NULL").select("id", "document_id", F.coalesce("text", F.lit("")).alias("text"), "chunk_index", "character_start", "character_end", "loaded_at")
    chunks = latest(live, "id", F.col("loaded_at"), F.col("text")).drop("loaded_at")
    entries = manifest(spark, d).select(F.col("id").alias("document_id"), "source", "canonical")
    return chunks.join(entries, "document_id", "left").select("id", "document_id", "text", "chunk_index", "character_start", "character_end", canonical_rank(F.col("canonical")).alias("canon"), F.coalesce("source", F.lit("~")).alias("source"))


def facts(spark: SparkSession, d: str) -> DataFrame:
    """The facts that are not deleted, one per id."""
    live = table(spark, d, "resume_facts").where("deleted_at IS NULL")
    return latest(live, "id", F.col("loaded_at"), F.coalesce("source_text", F.lit("")))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """The question pairs, one per id, as last ingested."""
    return latest(table(spark, d, "resume_qa_pairs"), "id", F.col("ingested_at"), F.coalesce("question", F.lit("")))


def expectations(spark: SparkSession, d: str) -> DataFrame:
    """The evidence trace, one entry per id, as last ingested."""
    return latest(table(spark, d, "resume_evidence_trace"), "id", F.col("ingested_at"), F.coalesce("question", F.lit("")))


def generations(spark: SparkSession, d: str) -> DataFrame:
    """The generation results, one per question pair: the latest."""
    return latest(table(spark, d, "generation_results"), "qa_id", F.col("generated_at"), F.col("id"))


def questions(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, question): the stated query set."""
    number = F.regexp_extract("id", "_f([0-9]+)_", 1)
    return pairs(spark, d).where((number != "") & (number.cast("long") % QUERY_STEP == 0)).select(F.col("id").alias("query_id"), F.coalesce("question", F.lit("")).alias("question"))


def observations(spark: SparkSession, d: str) -> DataFrame:
    """(id, observed_chunk): the chunks each latest generation rests on, under its trace id."""
    ids = F.transform(F.flatten(F.transform("statements", lambda s: s["supporting_evidence"])), lambda e: e["chunk_id"])
    return generations(spark, d).select(F.concat(F.lit("meta_"), "qa_id").alias("id"), F.coalesce(F.array_sort(F.array_distinct(F.filter(ids, lambda x: x.isNotNull()))), F.array().cast("array<string>")).alias("observed_chunk"))


# The same in SQL.
MANIFEST = "man AS (SELECT DISTINCT ON (id) id, source, hash, coalesce(canonical, false) AS canonical FROM manifest WHERE deleted_at IS NULL ORDER BY id, loaded_at DESC, coalesce(hash, '') DESC)"
CORPUS = (
    MANIFEST
    + """,
corpus AS (SELECT c.id, c.document_id, c.text, c.chunk_index, c.character_start, c.character_end, CASE WHEN m.canonical THEN 0 ELSE 1 END AS canon, coalesce(m.source, '~') AS source
  FROM (SELECT DISTINCT ON (id) id, document_id, coalesce(text, '') AS text, chunk_index, character_start, character_end FROM chunks WHERE deleted_at IS NULL ORDER BY id, loaded_at DESC, coalesce(text, '') DESC) c LEFT JOIN man m ON m.id = c.document_id)"""
)
FACTS = "fact AS (SELECT DISTINCT ON (id) * FROM resume_facts WHERE deleted_at IS NULL ORDER BY id, loaded_at DESC, coalesce(source_text, '') DESC)"
PAIRS = "pair AS (SELECT DISTINCT ON (id) * FROM resume_qa_pairs ORDER BY id, ingested_at DESC, coalesce(question, '') DESC)"
TRACE = "trace AS (SELECT DISTINCT ON (id) * FROM resume_evidence_trace ORDER BY id, ingested_at DESC, coalesce(question, '') DESC)"
GENERATED = "gen AS (SELECT DISTINCT ON (qa_id) * FROM generation_results ORDER BY qa_id, generated_at DESC, id DESC)"
QUESTIONS = PAIRS + f", questions AS (SELECT id AS query_id, coalesce(question, '') AS question FROM pair WHERE TRY_CAST(regexp_extract(id, '_f([0-9]+)_', 1) AS BIGINT) % {QUERY_STEP} = 0)"
OBSERVED = GENERATED + """,
observed AS (SELECT 'meta_' || qa_id AS id, coalesce(list_sort(list_distinct(list_filter(flatten(list_transform(statements, lambda s: list_transform(s.supporting_evidence, lambda e: e.chunk_id))), lambda x: x IS NOT NULL))), []) AS observed_chunk FROM gen)"""
RECORDS = TRACE + ", " + OBSERVED + """,
sides AS (SELECT t.id, list_sort(list_distinct(list_filter(t.expected_chunk, lambda x: x IS NOT NULL))) AS e, coalesce(o.observed_chunk, []) AS o FROM trace t LEFT JOIN observed o ON o.id = t.id),
records AS (SELECT id, e, o, list_sort(list_intersect(e, o)) AS m, CAST(len(e) AS INT) AS expected_count, CAST(len(o) AS INT) AS observed_count, CAST(len(list_intersect(e, o)) AS INT) AS matched_count,
  CASE WHEN len(list_intersect(e, o)) = len(e) AND len(o) = len(e) THEN 'Exact Match' WHEN len(list_intersect(e, o)) = len(e) THEN 'Full Coverage' WHEN len(list_intersect(e, o)) > 0 THEN 'Partial Match' ELSE 'No Match' END AS classification
  FROM sides WHERE len(e) > 0)"""

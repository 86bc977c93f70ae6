"""Queries on references between the record tables (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.operators import orphans as op
from corpusloom.runtime import table


def _references(spark: SparkSession, d: str) -> DataFrame:
    qa = op.references_of(table(spark, d, "resume_qa_pairs"), "resume_qa_pairs", "id", "recorded_at", {"fact_id": "facts", "supporting_fact_ids": "facts"})
    trace = op.references_of(table(spark, d, "resume_evidence_trace"), "resume_evidence_trace", "id", "recorded_at", {"expected_source": "manifest", "expected_chunk": "chunks"})
    return qa.unionByName(trace)


def _spans(spark: SparkSession, d: str) -> DataFrame:
    of = lambda name, target: op.parent_spans(table(spark, d, name), target, "id", "loaded_at", "deleted_at")
    return of("resume_facts", "facts").unionByName(of("manifest", "manifest")).unionByName(of("chunks", "chunks"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references: one row per table, record, field and key."""
    return op.orphans(_references(spark, d), _spans(spark, d)).select("ref_table", "record_id", "ref_field", "ref_key").distinct()


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """References and orphans per table, field and month."""
    refs = _references(spark, d)
    return op.orphan_report(refs, op.orphans(refs, _spans(spark, d)))


QUERIES = {"p6_found": p6_found, "p6_report": p6_report}

_REFS = """
refs0 AS (
  SELECT 'resume_qa_pairs' AS ref_table, id AS record_id, 'fact_id' AS ref_field, 'f' AS target, fact_id AS k, recorded_at FROM resume_qa_pairs
  UNION ALL SELECT 'resume_qa_pairs', id, 'supporting_fact_ids', 'f', unnest(supporting_fact_ids), recorded_at FROM resume_qa_pairs
  UNION ALL SELECT 'resume_evidence_trace', id, 'expected_source', 'm', expected_source, recorded_at FROM resume_evidence_trace
  UNION ALL SELECT 'resume_evidence_trace', id, 'expected_chunk', 'c', unnest(expected_chunk), recorded_at FROM resume_evidence_trace),
refs AS (SELECT DISTINCT ref_table, record_id, ref_field, target, lower(trim(k, E' \\t\\r\\n')) AS ref_key, recorded_at FROM refs0 WHERE trim(k, E' \\t\\r\\n') <> ''),
parents AS (
  SELECT 'f' AS target, lower(trim(id, E' \\t\\r\\n')) AS id, loaded_at, deleted_at FROM resume_facts
  UNION ALL SELECT 'm', lower(trim(id, E' \\t\\r\\n')), loaded_at, deleted_at FROM manifest
  UNION ALL SELECT 'c', lower(trim(id, E' \\t\\r\\n')), loaded_at, deleted_at FROM chunks),
bad AS (SELECT * FROM refs r WHERE NOT EXISTS (SELECT 1 FROM parents p WHERE p.target = r.target AND p.id = r.ref_key AND p.loaded_at <= r.recorded_at AND (p.deleted_at IS NULL OR p.deleted_at > r.recorded_at)))
"""

ORACLE = {
    "p6_found": f"WITH {_REFS} SELECT DISTINCT ref_table, record_id, ref_field, ref_key FROM bad",
    "p6_report": f"""WITH {_REFS}
SELECT ref_table, ref_field, strftime(recorded_at, '%Y-%m') AS month, count(*) AS n_refs,
  CAST(sum(CASE WHEN EXISTS (SELECT 1 FROM bad b WHERE b.ref_table = r.ref_table AND b.record_id = r.record_id AND b.ref_field = r.ref_field AND b.ref_key = r.ref_key) THEN 1 ELSE 0 END) AS BIGINT) AS n_orphans
FROM refs r GROUP BY ALL""",
}

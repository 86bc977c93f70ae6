"""Queries of problem 3: records that say nearly the same in nearly the same words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.edits import member_pairs, near_duplicate_classes, near_duplicate_groups, word_classes
from corpusloom.runtime import stage, table

THRESHOLD = 0.7


def _classes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    facts, fact_members = word_classes(table(spark, d, "resume_facts"), "resume_facts", "id", "fact", "loaded_at")
    asked, asked_members = word_classes(table(spark, d, "resume_qa_pairs"), "resume_qa_pairs", "id", "question", "ingested_at")
    return facts.unionByName(asked), fact_members.unionByName(asked_members)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of records of one table whose word sets have a Jaccard similarity of at least 0.7."""
    classes, members = _classes(spark, d)
    pairs = near_duplicate_classes(classes, THRESHOLD)
    return member_pairs(pairs, members).select(F.col("kind").alias("record_table"), "id_a", "id_b")


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every record with its class of equal word sets, its group of similar classes and its number of links."""
    classes, members = _classes(spark, d)
    pairs = stage(near_duplicate_classes(classes, THRESHOLD), "similar_classes")
    return near_duplicate_groups(pairs, members).select(F.col("kind").alias("record_table"), "id", "cls", "grp", "copies", "links")


QUERIES = {"p3_found": p3_found, "p3_groups": p3_groups}

_WORDS = """
WITH rows AS (
  SELECT 'resume_facts' AS t, id, arg_max(fact, (loaded_at, fact)) AS x FROM resume_facts WHERE fact IS NOT NULL GROUP BY id
  UNION ALL SELECT 'resume_qa_pairs', id, arg_max(question, (ingested_at, question)) FROM resume_qa_pairs WHERE question IS NOT NULL GROUP BY id),
sets AS (SELECT t, id, list_distinct(regexp_extract_all(lower(x), '[\\p{L}\\p{N}]+')) AS w FROM rows),
sized AS (SELECT t, id, len(w) AS n, w FROM sets WHERE len(w) > 0),
pairs AS (SELECT a.t AS record_table, a.id AS id_a, b.id AS id_b, len(list_intersect(a.w, b.w)) AS i, a.n + b.n AS n
  FROM sized a JOIN sized b ON a.t = b.t AND a.id < b.id AND a.n * 10 >= b.n * 7 AND b.n * 10 >= a.n * 7)
"""

ORACLE = {
    "p3_found": _WORDS + "SELECT record_table, id_a, id_b FROM pairs WHERE i * 10 >= 7 * (n - i)",
    "p3_groups": _WORDS.replace("WITH rows", "WITH RECURSIVE rows", 1)
    + """, cls AS (SELECT t, id, min(id) OVER (PARTITION BY t, list_sort(w)) AS c, count(*) OVER (PARTITION BY t, list_sort(w)) AS copies FROM sized),
link AS (SELECT DISTINCT p.record_table AS t, a.c AS a, b.c AS b FROM pairs p JOIN cls a ON a.t = p.record_table AND a.id = p.id_a JOIN cls b ON b.t = p.record_table AND b.id = p.id_b WHERE i * 10 >= 7 * (n - i) AND a.c <> b.c),
both_ AS (SELECT t, a, b FROM link UNION SELECT t, b, a FROM link),
reach AS (SELECT DISTINCT t, c AS a, c AS b FROM cls UNION SELECT r.t, r.a, e.b FROM reach r JOIN both_ e ON e.t = r.t AND e.a = r.b),
grp AS (SELECT t, a, min(b) AS g FROM reach GROUP BY ALL), deg AS (SELECT t, a, count(*) AS links FROM both_ GROUP BY ALL)
SELECT c.t AS record_table, c.id, c.c AS cls, g.g AS grp, c.copies, coalesce(d.links, 0) AS links FROM cls c JOIN grp g ON g.t = c.t AND g.a = c.c LEFT JOIN deg d ON d.t = c.t AND d.a = c.c""",
}

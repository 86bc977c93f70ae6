"""Queries of problem 2: the most similar vectors of every vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.neighbours import nearest, usable_vectors
from corpusloom.runtime import table


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The 10 most similar other vectors of each usable vector, with cosine and rank."""
    return nearest(usable_vectors(table(spark, d, "index_vectors"), table(spark, d, "index_identity")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Unordered pairs of which either is among the 10 most similar of the other."""
    x = p2_neighbours(spark, d)
    return x.select(F.least("vec_id", "other_id").alias("vec_id_a"), F.greatest("vec_id", "other_id").alias("vec_id_b")).distinct()


QUERIES = {"p2_found": p2_found, "p2_neighbours": p2_neighbours}

_NEAREST = """
WITH dims AS (SELECT DISTINCT index_id, dimension FROM index_identity),
ok AS (
  SELECT v.index_id, v.vec_id, min(CAST(v.vector AS DOUBLE[])) AS x FROM index_vectors v JOIN dims USING (index_id)
  WHERE v.vec_id IS NOT NULL AND len(v.vector) = dimension AND len(list_filter(v.vector, lambda y: y IS NOT NULL AND isfinite(y))) = dimension AND len(list_filter(v.vector, lambda y: y <> 0)) > 0
  GROUP BY 1, 2),
pairs AS (SELECT a.index_id, a.vec_id, b.vec_id AS other_id, round(list_cosine_similarity(a.x, b.x), 6) AS sim FROM ok a JOIN ok b ON a.index_id = b.index_id AND a.vec_id <> b.vec_id),
best AS (SELECT *, CAST(row_number() OVER (PARTITION BY index_id, vec_id ORDER BY sim DESC, other_id) AS INT) AS rank FROM pairs QUALIFY rank <= 10)
"""

ORACLE = {
    "p2_found": _NEAREST + "SELECT DISTINCT least(vec_id, other_id) AS vec_id_a, greatest(vec_id, other_id) AS vec_id_b FROM best",
    "p2_neighbours": _NEAREST + "SELECT index_id, vec_id, other_id, sim, rank FROM best",
}
